"""Session set-up shared by tests, bench and command-line use."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", *, shuffle_partitions: int = 8, name: str = "siftara", **conf: str) -> SparkSession:
    """A session with UTC stamps and adaptive execution; keyword conf uses ``__`` for ``.``.

    A local master gets a temporary ``spark.checkpoint.dir`` unless ``conf`` names one; a cluster must name its shared folder itself.
    """
    settings = {key.replace("__", "."): value for key, value in conf.items()}
    if master.startswith("local") and "spark.checkpoint.dir" not in settings:
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="siftara-")
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
