"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and ANSI SQL; more settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for an application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).parent
        out = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(out))
        _SHIPPED.add(app)
    return spark


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without one, a session on this machine alone has a temporary folder, any other raises
    RuntimeError: each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
