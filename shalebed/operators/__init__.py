"""What a table can be asked: the names that users import."""

from ..plans.predicate import compare, field
from ..plans.views import MaterializedView, Range, View
from ..sources.catalog import DirCatalog
from ..sources.records import RandomAccess
from ..table import Dataset, JobResult

__all__ = ["Dataset", "DirCatalog", "JobResult", "MaterializedView", "RandomAccess", "Range", "View", "compare", "field"]
