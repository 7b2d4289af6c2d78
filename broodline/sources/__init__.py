from broodline.sources.tables import read_table, table_path, with_row_ord  # noqa: F401
from broodline.sources.adapters import (  # noqa: F401
    brood_view, capture_view, populations_view, done_view, BROOD_VIEW_SQL, CAPTURE_VIEW_SQL,
)
from broodline.sources.rcsv import read_csv_r, write_csv_r  # noqa: F401
from broodline.sources.schemas import BROOD_SCHEMA, CAPTURE_SCHEMA, PAIRS_SCHEMA  # noqa: F401
