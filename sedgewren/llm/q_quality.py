from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.byte_cnn import classify
from sedgewren.llm.common import documents


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
