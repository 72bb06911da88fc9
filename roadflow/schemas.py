"""Column lists and schemas of the feeds and of the processed table."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["BucketTime", "DeviceId", "Lane"]
SERIES = ["DeviceId", "Lane"]

TRAFFIC_METRICS = ["NumVehicles", "AvgSpeed", "Occupancy", "AvgDensity", "AvgHeadway", "FlowRate"]
VEHICLE_NUMBERS = ["VehicleClass", "Speed", "TravelTimeSec", "Confidence"]
VEHICLE_STATS = ["AvgTravelTime", "MedianSpeed", "SpeedStd", "MeanConfidence"]
CATEGORIES = ["Car", "Truck", "Bus", "Motorcycle", "OtherVehicle"]
COUNT_COLS = ["CarCount", "TruckCount", "BusCount", "MotorcycleCount", "OtherVehicleCount"]
RATIO_COLS = ["CarRatio", "TruckRatio", "BusRatio", "MotorcycleRatio"]
WEATHER_COLS = ["Rain", "Temperature", "Humidity", "Visibility", "WindSpeed"]
PROFILE_COLS = TRAFFIC_METRICS + COUNT_COLS + VEHICLE_STATS + RATIO_COLS
CALENDAR_COLS = ["Hour", "DayOfWeek", "IsHoliday", "IsWeekend", "Day", "Month"]
ROLLING = {"15m": 3, "30m": 6}
ROLL_COLS = [
    f"{col}_roll_{stat}_{span}"
    for col in ("NumVehicles", "AvgSpeed")
    for span in ROLLING
    for stat in ("mean", "std")
]
FINAL_COLS = (
    ["BucketTime"] + CALENDAR_COLS + ["DeviceId", "Lane"] + PROFILE_COLS + WEATHER_COLS + ROLL_COLS
)
STRICT_COLS = [c for c in FINAL_COLS if c != "OtherVehicleCount"]

# Class codes of the detectors; every other code is OtherVehicle.
CLASS_TO_CATEGORY = {2: "Motorcycle", 3: "Car", 6: "Truck", 7: "Bus"}

# Last-resort defaults for measures that no profile covers.
TRAFFIC_DEFAULTS = {
    "NumVehicles": 0.0, "AvgSpeed": 50.0, "Occupancy": 10.0, "AvgDensity": 20.0,
    "AvgHeadway": 2.0, "FlowRate": 0.0, "CarCount": 0.0, "TruckCount": 0.0, "BusCount": 0.0,
    "MotorcycleCount": 0.0, "OtherVehicleCount": 0.0, "AvgTravelTime": 600.0,
    "MedianSpeed": 50.0, "SpeedStd": 18.0, "MeanConfidence": 87.0, "CarRatio": 0.39,
    "TruckRatio": 0.03, "BusRatio": 0.02, "MotorcycleRatio": 0.47,
}
WEATHER_DEFAULTS = {
    "Rain": 0.0, "Temperature": 25.0, "Humidity": 75.0, "Visibility": 9000.0, "WindSpeed": 3.0,
}

# Accepted ranges; a value outside becomes null.
VALID_RANGES = {"Speed": (0.0, 250.0), "TravelTimeSec": (0.0, 86400.0), "Confidence": (0.0, 100.0)}

# Regressors of each forecast target.
TARGET_REGRESSORS = {
    "NumVehicles": ["AvgSpeed", "Occupancy", "AvgDensity"] + WEATHER_COLS,
    "AvgSpeed": ["Occupancy"] + WEATHER_COLS,
}


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


_S, _D, _I, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()

# CSV feeds arrive as text: times, lanes and codes are parsed by the cleaning
# step so that junk becomes null instead of failing the scan.
TRAFFIC_SCHEMA = _fields(
    Id=_S, BucketTime=_S, DeviceId=_S, NodeId=_S, Lane=_S, IntervalType=_S,
    **{c: _S for c in TRAFFIC_METRICS}, OccurDate=_S, Confidence=_S,
)
VEHICLE_SCHEMA = _fields(
    Id=_S, Plate=_S, BucketTime=_S, DeviceId=_S, NodeId=_S, Lane=_S, VehicleClass=_S, Speed=_S,
    TravelTimeSec=_S, Confidence=_S, OccurDate=_S, VehicleColor=_S,
)
WEATHER_SCHEMA = _fields(BucketTime=_S, **{c: _S for c in WEATHER_COLS})

METRICS_SCHEMA = _fields(
    DeviceId=_S, TargetCol=_S, MAE=_D, RMSE=_D, MAPE=_D, R2=_D,
)
