"""The types of samples as a dimension: adding a type is adding a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key, display name, group, kind, unit, scale, frequency; in the order in which types are synchronised.
ROWS = [
    ("sleepAnalysis", "Sleep", "Sleep & Circadian", "category", None, None, "immediate"),
    ("timeInDaylight", "Time in Daylight", "Sleep & Circadian", "quantity", "min", 1.0, "hourly"),
    ("appleSleepingWristTemperature", "Sleeping Wrist Temperature", "Sleep & Circadian", "quantity", "°C", 1.0, "hourly"),
    ("appleSleepingBreathingDisturbances", "Breathing Disturbances", "Sleep & Circadian", "quantity", "count", 1.0, "hourly"),
    ("appleStandHour", "Stand Hours", "Sleep & Circadian", "category", None, None, "hourly"),
    ("mindfulSession", "Mindful Sessions", "Sleep & Circadian", "category", None, None, "hourly"),
    ("workout", "Workouts", "Workouts", "workout", None, None, "immediate"),
    ("stepCount", "Steps", "Energy & Activity", "quantity", "count", 1.0, "hourly"),
    ("activeEnergyBurned", "Active Energy", "Energy & Activity", "quantity", "kcal", 1.0, "hourly"),
    ("basalEnergyBurned", "Basal Energy", "Energy & Activity", "quantity", "kcal", 1.0, "hourly"),
    ("physicalEffort", "Physical Effort", "Energy & Activity", "quantity", "kcal/hr·kg", 1.0, "hourly"),
    ("appleExerciseTime", "Exercise Time", "Energy & Activity", "quantity", "min", 1.0, "hourly"),
    ("appleStandTime", "Stand Time", "Energy & Activity", "quantity", "min", 1.0, "hourly"),
    ("flightsClimbed", "Flights Climbed", "Energy & Activity", "quantity", "count", 1.0, "hourly"),
    ("distanceWalkingRunning", "Walking + Running Distance", "Energy & Activity", "quantity", "m", 1.0, "hourly"),
    ("distanceCycling", "Cycling Distance", "Energy & Activity", "quantity", "m", 1.0, "hourly"),
    ("distanceSwimming", "Swimming Distance", "Energy & Activity", "quantity", "m", 1.0, "hourly"),
    ("swimmingStrokeCount", "Swimming Strokes", "Energy & Activity", "quantity", "count", 1.0, "hourly"),
    ("heartRate", "Heart Rate", "Cardio & Recovery", "quantity", "count/min", 1.0, "hourly"),
    ("restingHeartRate", "Resting Heart Rate", "Cardio & Recovery", "quantity", "count/min", 1.0, "hourly"),
    ("heartRateVariabilitySDNN", "HRV (SDNN)", "Cardio & Recovery", "quantity", "ms", 1.0, "hourly"),
    ("vo2Max", "VO₂ Max", "Cardio & Recovery", "quantity", "mL/(kg·min)", 1.0, "hourly"),
    ("heartRateRecoveryOneMinute", "Heart Rate Recovery", "Cardio & Recovery", "quantity", "count/min", 1.0, "hourly"),
    ("walkingHeartRateAverage", "Walking Heart Rate Avg", "Cardio & Recovery", "quantity", "count/min", 1.0, "hourly"),
    ("oxygenSaturation", "Blood Oxygen", "Cardio & Recovery", "quantity", "%", 100.0, "hourly"),
    ("respiratoryRate", "Respiratory Rate", "Cardio & Recovery", "quantity", "count/min", 1.0, "hourly"),
    ("bodyMass", "Body Mass", "Body", "quantity", "kg", 1.0, "hourly"),
    ("bodyFatPercentage", "Body Fat", "Body", "quantity", "%", 100.0, "hourly"),
    ("leanBodyMass", "Lean Body Mass", "Body", "quantity", "kg", 1.0, "hourly"),
    ("bodyMassIndex", "Body Mass Index", "Body", "quantity", "count", 1.0, "hourly"),
    ("waistCircumference", "Waist Circumference", "Body", "quantity", "cm", 1.0, "hourly"),
    ("height", "Height", "Body", "quantity", "cm", 1.0, "hourly"),
    ("runningPower", "Running Power", "Running & Gait", "quantity", "W", 1.0, "hourly"),
    ("runningSpeed", "Running Speed", "Running & Gait", "quantity", "m/s", 1.0, "hourly"),
    ("runningStrideLength", "Running Stride Length", "Running & Gait", "quantity", "m", 1.0, "hourly"),
    ("runningVerticalOscillation", "Vertical Oscillation", "Running & Gait", "quantity", "cm", 1.0, "hourly"),
    ("runningGroundContactTime", "Ground Contact Time", "Running & Gait", "quantity", "ms", 1.0, "hourly"),
    ("walkingSpeed", "Walking Speed", "Running & Gait", "quantity", "m/s", 1.0, "hourly"),
    ("walkingStepLength", "Walking Step Length", "Running & Gait", "quantity", "cm", 1.0, "hourly"),
    ("walkingAsymmetryPercentage", "Walking Asymmetry", "Running & Gait", "quantity", "%", 100.0, "hourly"),
    ("walkingDoubleSupportPercentage", "Double Support", "Running & Gait", "quantity", "%", 100.0, "hourly"),
    ("appleWalkingSteadiness", "Walking Steadiness", "Running & Gait", "quantity", "%", 100.0, "hourly"),
    ("sixMinuteWalkTestDistance", "Six-Minute Walk", "Running & Gait", "quantity", "m", 1.0, "hourly"),
    ("stairAscentSpeed", "Stair Ascent Speed", "Running & Gait", "quantity", "m/s", 1.0, "hourly"),
    ("stairDescentSpeed", "Stair Descent Speed", "Running & Gait", "quantity", "m/s", 1.0, "hourly"),
    ("environmentalAudioExposure", "Environmental Sound", "Audio Exposure", "quantity", "dBASPL", 1.0, "hourly"),
    ("headphoneAudioExposure", "Headphone Audio", "Audio Exposure", "quantity", "dBASPL", 1.0, "hourly"),
    ("dietaryEnergyConsumed", "Dietary Energy", "Nutrition", "quantity", "kcal", 1.0, "hourly"),
    ("dietaryProtein", "Protein", "Nutrition", "quantity", "g", 1.0, "hourly"),
    ("dietaryCarbohydrates", "Carbohydrates", "Nutrition", "quantity", "g", 1.0, "hourly"),
    ("dietaryFatTotal", "Total Fat", "Nutrition", "quantity", "g", 1.0, "hourly"),
    ("dietaryFiber", "Fiber", "Nutrition", "quantity", "g", 1.0, "hourly"),
    ("dietarySugar", "Sugar", "Nutrition", "quantity", "g", 1.0, "hourly"),
    ("dietarySodium", "Sodium", "Nutrition", "quantity", "mg", 1.0, "hourly"),
    ("dietaryWater", "Water", "Nutrition", "quantity", "mL", 1.0, "hourly"),
    ("dietaryCaffeine", "Caffeine", "Nutrition", "quantity", "mg", 1.0, "hourly"),
    ("numberOfAlcoholicBeverages", "Alcoholic Beverages", "Nutrition", "quantity", "count", 1.0, "hourly"),
]

#: Names of the stages of sleep.
SLEEP_STAGES = ["inBed", "asleepUnspecified", "awake", "asleepCore", "asleepDeep", "asleepREM"]

#: Names of what a stand hour holds.
STAND_HOURS = ["stood", "idle"]

#: Names of the activities of workouts, in alphabetical order. Their codes are input data.
ACTIVITIES = [
    "americanFootball", "archery", "australianFootball", "badminton", "barre", "baseball", "basketball", "bowling", "boxing",
    "cardioDance", "climbing", "cooldown", "coreTraining", "cricket", "crossCountrySkiing", "crossTraining", "curling", "cycling",
    "discSports", "downhillSkiing", "elliptical", "equestrianSports", "fencing", "fishing", "fitnessGaming", "flexibility",
    "functionalStrengthTraining", "golf", "gymnastics", "handball", "handCycling", "highIntensityIntervalTraining", "hiking",
    "hockey", "hunting", "jumpRope", "kickboxing", "lacrosse", "martialArts", "mindAndBody", "mixedCardio", "other",
    "paddleSports", "pickleball", "pilates", "play", "preparationAndRecovery", "racquetball", "rowing", "rugby", "running",
    "sailing", "skatingSports", "snowboarding", "snowSports", "soccer", "socialDance", "softball", "squash", "stairClimbing",
    "stairs", "stepTraining", "surfingSports", "swimBikeRun", "swimming", "tableTennis", "taiChi", "tennis", "trackAndField",
    "traditionalStrengthTraining", "transition", "underwaterDiving", "volleyball", "walking", "waterFitness", "waterPolo",
    "waterSports", "wheelchairRunPace", "wheelchairWalkPace", "wrestling", "yoga",
]

#: Conversions to the canonical unit, as (unit, canonical unit, factor, offset).
UNITS = [
    ("s", "min", 1 / 60, 0.0), ("h", "min", 60.0, 0.0), ("min", "min", 1.0, 0.0), ("ms", "ms", 1.0, 0.0), ("s", "ms", 1000.0, 0.0),
    ("degF", "°C", 5 / 9, -160 / 9), ("°C", "°C", 1.0, 0.0), ("lb", "kg", 0.45359237, 0.0), ("g", "kg", 0.001, 0.0), ("kg", "kg", 1.0, 0.0),
    ("in", "cm", 2.54, 0.0), ("m", "cm", 100.0, 0.0), ("cm", "cm", 1.0, 0.0), ("km", "m", 1000.0, 0.0), ("mi", "m", 1609.344, 0.0),
    ("m", "m", 1.0, 0.0), ("J", "kcal", 1 / 4184, 0.0), ("kJ", "kcal", 1 / 4.184, 0.0), ("kcal", "kcal", 1.0, 0.0),
    ("L", "mL", 1000.0, 0.0), ("mL", "mL", 1.0, 0.0), ("g", "mg", 1000.0, 0.0), ("mg", "mg", 1.0, 0.0), ("g", "g", 1.0, 0.0),
]


def registry(spark: SparkSession) -> DataFrame:
    """The dimension of types: ord, key, display, group, kind, unit, scale, frequency. 57 rows, so it may be broadcast."""
    rows = [(i, *r) for i, r in enumerate(ROWS, 1)]
    return spark.createDataFrame(
        rows, "ord int, key string, display string, `group` string, kind string, unit string, scale double, frequency string"
    )


def converted(value: Column, factor: Column, offset: Column, scale: Column) -> Column:
    """A value in the canonical unit: linear conversion, then the scale (100 for shares shown as percent)."""
    return (value * factor + offset) * scale


def measured(df: DataFrame, types: DataFrame, type_col: str = "sample_type", value: str = "value_num", unit: str = "unit_label") -> DataFrame:
    """``df`` with ``measure`` (the value in the registry's unit, times its scale) and ``unit``.

    A value in another unit is converted if UNITS has the pair; a unit that is null or has no conversion counts as the
    registry's own. Types that the registry lacks, and types without a unit, have neither.
    """
    spark = df.sparkSession
    dim = F.broadcast(types.select(F.col("key").alias("_key"), F.col("scale").alias("_scale"), F.col("unit").alias("_unit")))
    pairs = F.broadcast(spark.createDataFrame(UNITS, "_from string, _to string, _factor double, _offset double"))
    full = df.drop("unit").join(dim, F.col(type_col) == F.col("_key"), "left")
    full = full.join(pairs, (F.col(unit) == F.col("_from")) & (F.col("_unit") == F.col("_to")), "left")
    own = converted(F.col(value), F.coalesce("_factor", F.lit(1.0)), F.coalesce("_offset", F.lit(0.0)), F.col("_scale"))
    return full.withColumns({"measure": own, "unit": F.col("_unit")}).drop("_key", "_scale", "_unit", "_from", "_to", "_factor", "_offset")


def labelled(df: DataFrame, labels: DataFrame, code: str, prefix: str = "value_", name: str = "label") -> DataFrame:
    """``df`` with the label of its code, or prefix and code where ``labels`` (code, label; a small dimension) has none.

    A null code has no label.
    """
    dim = F.broadcast(labels.select(F.col("code").alias("_code"), F.col("label").alias("_label")))
    other = F.concat(F.lit(prefix), F.col(code).cast("string"))
    return df.join(dim, F.col(code) == F.col("_code"), "left").withColumn(name, F.coalesce("_label", other)).drop("_code", "_label")
