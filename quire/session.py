"""A local session with the settings that the tests and the benchmark use."""

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "6g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
