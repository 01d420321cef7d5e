"""Which sources may be used, by licence, list and stated decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Licences that allow commercial use without share-alike.
ALLOWED = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "cc-by-3.0", "cc-by-4.0")
#: Licence marks that forbid commercial use or derivatives.
FORBIDDEN = r"(?i)(^|[-_ ])n[cd]($|[-_ .\d])|non-?commercial|no-?deriv"
#: Sources, by key or hub id, that must never train a model whatever their licence says.
DENIED = (
    r"(^|[/_\-\s])(bbh|big[-_ ]?bench([-_ ]?hard)?)($|[/_\-\s])",
    r"gpqa",
    r"(^|/)hle($|[-_/])",
    r"(^|/)anli$|facebook/anli|adversarial[-_ ]?nli",
    r"ragtruth",
    r"hellaswag",
)
DECISIONS, ROLES = ("allow", "review", "deny"), ("train", "heldout")


def licence_status(licence: Column) -> Column:
    """deny for a forbidden mark, allow for a listed licence, else review; a null licence is for review."""
    return F.when(licence.rlike(FORBIDDEN), "deny").when(F.lower(licence).isin(*ALLOWED), "allow").otherwise("review")


def denied(key: Column, hub_id: Column, licence: Column) -> Column:
    """Whether a source may never train a model. Never null."""
    listed = F.lit(False)
    for pattern in DENIED:
        listed = listed | F.coalesce(key.rlike(f"(?i){pattern}"), F.lit(False)) | F.coalesce(hub_id.rlike(f"(?i){pattern}"), F.lit(False))
    return listed | F.coalesce(licence.rlike(FORBIDDEN), F.lit(False))


def policy_problems(key: Column, hub_id: Column, licence: Column, decision: Column, evidence: Column, role: Column) -> Column:
    """Names of what breaks the policy in a registry row; empty for a good one. Allowing needs a listed licence and evidence."""
    allow = decision == "allow"
    checks = (
        ("decision", ~F.coalesce(decision.isin(*DECISIONS), F.lit(False))),
        ("role", ~F.coalesce(role.isin(*ROLES), F.lit(False))),
        ("denied", denied(key, hub_id, licence) & ~F.coalesce(decision == "deny", F.lit(False))),
        ("licence", allow & ~F.coalesce(F.lower(licence).isin(*ALLOWED), F.lit(False))),
        ("evidence", allow & (F.trim(F.coalesce(evidence, F.lit(""))) == "")),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def usable(decision: Column, role: Column, *, wanted: str = "train", review: bool = False) -> Column:
    """Whether a source can be used for ``wanted``: its role and its decision. The policy holds decision and licence together (``policy_problems``)."""
    decided = decision.isin("allow", "review") if review else decision == "allow"
    return F.coalesce((role == wanted) & decided, F.lit(False))
