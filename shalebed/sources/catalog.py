"""A directory of named tables and materialised views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import StorageNotFoundError
from ..plans.views import MaterializedView, View
from ..table import Dataset
from .log import Log, Store


class DirCatalog:
    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.location}/{name}"

    def create_dataset(self, name: str, schema, primary_keys: list[str], record_fields: list[str] | None = None) -> Dataset:
        return Dataset.create(self.spark, self._at(name), schema, primary_keys, record_fields)

    def materialize(self, name: str, view: View) -> MaterializedView:
        return view.materialize(self._at(name))

    def _loaded(self, name: str) -> Dataset:
        return Dataset.load(self.spark, self._at(name))

    def dataset(self, name: str) -> Dataset | MaterializedView:
        found = self._loaded(name)
        return MaterializedView.load(self.spark, self._at(name)) if "plan" in found.log.state else found

    def datasets(self) -> list[str]:
        return [n for n in Store(self.spark, self.location).names("") if Log(Store(self.spark, self._at(n))).exists()]

    def delete_dataset(self, name: str) -> None:
        if name not in self.datasets():
            raise StorageNotFoundError(f"No table {name}")
        Store(self.spark, self._at(name)).delete_all()

    def register(self) -> list[str]:
        """A temporary view of each table's current rows, for SQL."""
        for n in (names := self.datasets()):
            self.dataset(n).df().createOrReplaceTempView(n)
        return names
