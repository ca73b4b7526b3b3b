"""Property endpoints: random forests on fingerprints."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from .similarity import on_bits

# The public benchmark endpoints by kind.
CLASSIFICATION = ["AMES", "BBB_Martins", "Bioavailability_Ma", "CYP1A2_Veith", "CYP2C19_Veith", "CYP2C9_Veith", "CYP2D6_Veith", "CYP3A4_Veith", "ClinTox", "DILI", "HIA_Hou", "Pgp_Broccatelli", "hERG"]
REGRESSION = ["Caco2_Wang", "Clearance_Hepatocyte_AZ", "Clearance_Microsome_AZ", "HydrationFreeEnergy_FreeSolv", "LD50_Zhu", "Lipophilicity_AstraZeneca", "PPBR_AZ", "Solubility_AqSolDB", "VDss_Lombardo"]


def features(df: DataFrame, smiles: str = "smiles", nbits: int = 1024) -> DataFrame:
    """df with ok and the vector features, a 0 or 1 for each fingerprint bit."""
    own = df.withColumn("ok", columns.parse(smiles, "full")["ok"]).withColumn("__fp", columns.fingerprint(smiles, "ecfp4", 2, nbits))
    own = own.withColumn("__bits", on_bits(F.col("__fp"), nbits))
    dense = F.transform(F.sequence(F.lit(0), F.lit(nbits - 1)), lambda i: F.when(F.array_contains("__bits", i), 1.0).otherwise(0.0))
    return own.withColumn("features", array_to_vector(dense)).drop("__bits", "__fp")


class EndpointModel:
    """A forest for one endpoint. Predictions of invalid molecules are NaN."""

    def __init__(self, model, classifies: bool, nbits: int):
        self.model, self.classifies, self.nbits = model, classifies, nbits

    @classmethod
    def fit(cls, df: DataFrame, label: str = "label", classifies: bool = True, trees: int = 300, nbits: int = 1024, seed: int = 42) -> EndpointModel:
        forest = RandomForestClassifier if classifies else RandomForestRegressor
        own = features(df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))), nbits=nbits).where("ok").withColumn("label", F.col(label).cast("double"))
        return cls(forest(numTrees=trees, seed=seed, maxDepth=10).fit(own.select("features", "label")), classifies, nbits)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction: the probability of class 1, or the value."""
        out = self.model.transform(features(df, nbits=self.nbits))
        value = vector_to_array("probability")[1] if self.classifies else F.col("prediction")
        return out.withColumn("prediction", F.when(F.col("ok"), value).otherwise(F.lit(float("nan")))).select(*df.columns, "prediction")

    def predict_with_threshold(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """df with positive: true, false, or null for invalid molecules."""
        if not self.classifies:
            raise ValueError("only classifiers have a threshold")
        return self.predict(df).withColumn("positive", F.when(~F.isnan("prediction"), F.col("prediction") >= threshold)).drop("prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, classifies: bool = True, nbits: int = 1024) -> EndpointModel:
        kind = RandomForestClassificationModel if classifies else RandomForestRegressionModel
        return cls(kind.load(path), classifies, nbits)
