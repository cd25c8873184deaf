"""Table schemas."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType, "ts": T.TimestampNTZType, "str": T.StringType, "dbl": T.DoubleType, "bool": T.BooleanType, "int": T.IntegerType}
    return T.StructType([T.StructField(n, kinds[k]()) for n, k in (x.split(":") for x in spec.split())])


EVENTS = _struct(
    "event_id:long timestamp:ts category:str base_price:dbl surge_multiplier:dbl final_price:dbl demand_level:dbl "
    "supply_level:dbl distance_miles:dbl duration_minutes:dbl region:str label_is_anomaly:bool label_type:str"
)
TRUTH = _struct("timestamp:ts category:str anomaly_type:str severity:str expected_price:dbl actual_price:dbl description:str")
ALERTS = _struct(
    "event_id:long timestamp:ts category:str detection_method:str anomaly_type:str anomaly_score:dbl severity:str final_price:dbl "
    "expected_price_low:dbl expected_price_high:dbl description:str estimated_impact_usd:dbl recommended_action:str"
)
RUNS = _struct(
    "run_id:long started_at:ts completed_at:ts events_processed:long anomalies_detected:long methods_used:str status:str error_message:str"
)
PERFORMANCE = _struct("run_id:long method:str precision_score:dbl recall_score:dbl f1_score:dbl evaluated_at:ts")
TRIPS = _struct("tpep_pickup_datetime:ts tpep_dropoff_datetime:ts trip_distance:dbl total_amount:dbl PULocationID:int")
NUMERIC = [f.name for f in EVENTS if isinstance(f.dataType, T.DoubleType)]
