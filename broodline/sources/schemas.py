"""Declared schemas of the inputs and of the pair table (no read-time inference)."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BROOD_SCHEMA = _st(
    ("row_ord", _L), ("Species", _S), ("PopID", _S), ("BreedingSeason", _I), ("LocationID", _S),
    ("FemaleID", _S), ("MaleID", _S), ("ClutchType_calculated", _S), ("LayDate_observed", _D),
    ("LayDate", _D), ("ClutchSize_observed", _I), ("ClutchSize", _I), ("BroodSize_observed", _I),
    ("BroodSize", _I), ("NumberFledged_observed", _I), ("NumberFledged", _I), ("ExperimentID", _S),
)

CAPTURE_SCHEMA = _st(
    ("row_ord", _L), ("Species", _S), ("CapturePopID", _S), ("IndvID", _S), ("BreedingSeason", _I),
    ("CaptureDate", _D), ("Sex_observed", _S), ("Age_calculated", _I), ("ExperimentID", _S),
)

PAIRS_SCHEMA = _st(
    ("pop", _S), ("nest", _S), ("year", _I), ("female", _S), ("f_pair_num", _L), ("male", _S),
    ("m_pair_num", _L), ("order", _I), ("no_order_f", _S), ("no_order_m", _S),
    ("source_rank", _I), ("row_ord", _L),
)
