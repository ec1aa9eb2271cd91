from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.common import documents
from sedgewren.llm.toxicity import classify


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
