"""Dataset cleaning, profiling, editing and chart aggregation on Spark DataFrames."""
from tabsmith.operators.charts import ChartFilter
from tabsmith.operators.edits import EditRules, Merge, Replacement, apply_edits
from tabsmith.operators.profile import profile
from tabsmith.operators.ranges import RangeConfig
from tabsmith.operators.tags import TagConfig
from tabsmith.plans.charts import ChartSpec, run_chart
from tabsmith.plans.ingest import ingest_csv
from tabsmith.plans.query import query, run_query
from tabsmith.session import build_session
from tabsmith.sources.csv import read_csv_clean
from tabsmith.sources.dataset import open_dataset, preview, write_dataset

__all__ = [
    "ChartFilter", "ChartSpec", "EditRules", "Merge", "RangeConfig", "Replacement", "TagConfig", "apply_edits",
    "build_session", "ingest_csv", "open_dataset", "preview", "profile", "query", "read_csv_clean", "run_chart",
    "run_query", "write_dataset",
]
