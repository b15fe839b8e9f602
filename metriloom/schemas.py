"""Table schemas and fixed value tables."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source", T.StringType()),
    ]
)

#: One posted payload. Values and times stay text so that a bad one can be told from a missing one.
ENVELOPE = T.StructType(
    [
        T.StructField(
            "metrics",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("value", T.StringType()),
                        T.StructField("timestamp", T.StringType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("source", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("agent_version", T.StringType()),
        T.StructField("sent_at", T.StringType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("data_points", T.LongType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("deployed", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

# ---- fixed values -------------------------------------------------------------------------

#: USD per unit and hour
UNIT_PRICES = {"cpu": 0.0445, "memory": 0.0049, "storage": 0.0001}
HOURS_PER_DAY = 24
HOURS_PER_MONTH = 24 * 30

#: share of the list price that a purchase plan saves
PLAN_DISCOUNTS = {"on_demand": 0.0, "spot": 0.60, "committed_1yr": 0.37, "committed_3yr": 0.55}

#: aligner per metric type in the training path; anything else is a mean
TRAINING_ALIGNERS = {
    "kubernetes.io/container/cpu/core_usage_time": "ALIGN_RATE",
    "kubernetes.io/container/memory/used_bytes": "ALIGN_MEAN",
    "kubernetes.io/container/restart_count": "ALIGN_DELTA",
    "kubernetes.io/container/cpu/limit_utilization": "ALIGN_MEAN",
    "kubernetes.io/container/memory/limit_utilization": "ALIGN_MEAN",
    "cloudsql.googleapis.com/database/cpu/utilization": "ALIGN_MEAN",
    "cloudsql.googleapis.com/database/memory/utilization": "ALIGN_MEAN",
    "cloudsql.googleapis.com/database/postgresql/num_backends": "ALIGN_MEAN",
    "redis.googleapis.com/stats/memory/usage_ratio": "ALIGN_MEAN",
    "redis.googleapis.com/stats/connected_clients": "ALIGN_MEAN",
}

#: name fragments that mark a gauge in the collection path; anything else is a rate
GAUGE_FRAGMENTS = ("utilization", "memory/used", "limit_utilization")

#: column of the wide frame per family and metric type
METRIC_FAMILIES = {
    "container": {
        "kubernetes.io/container/memory/used_bytes": "memory_bytes",
        "kubernetes.io/container/cpu/limit_utilization": "cpu_utilization",
        "kubernetes.io/container/memory/limit_utilization": "memory_utilization",
    },
    "loadtest": {
        "prometheus.googleapis.com/locust_requests_current_rps/gauge": "rps",
        "prometheus.googleapis.com/locust_users/gauge": "users",
        "prometheus.googleapis.com/locust_response_times/histogram": "latency",
    },
    "database": {
        "cloudsql.googleapis.com/database/cpu/utilization": "db_cpu",
        "cloudsql.googleapis.com/database/memory/utilization": "db_memory",
        "cloudsql.googleapis.com/database/postgresql/num_backends": "db_connections",
    },
    "cloud": {
        "AWS/EC2/CPUUtilization": "ec2_cpu_utilization",
        "AWS/EC2/NetworkIn": "ec2_network_in",
        "AWS/EC2/NetworkOut": "ec2_network_out",
        "AWS/RDS/CPUUtilization": "rds_cpu_utilization",
        "AWS/RDS/DatabaseConnections": "rds_database_connections",
        "AWS/RDS/FreeableMemory": "rds_freeable_memory",
        "AWS/ApplicationELB/RequestCount": "applicationelb_request_count",
        "AWS/ApplicationELB/TargetResponseTime": "applicationelb_target_response_time",
    },
}

SEVERITY_FLOORS = {"critical": 4.0, "high": 3.0, "medium": 2.5}
SENSITIVITY_SIGMA = {"low": 3.0, "medium": 2.5, "high": 2.0}

#: buckets in seconds of the service's own histograms
REQUEST_LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
PREDICTION_LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
DETECTION_LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
RECOMMENDATION_LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
LOAD_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)

#: alert rules: condition on a named expression, pending time in minutes, severity
ALERT_RULES = (
    ("ServiceDown", "up", "==", 0.0, 1, "critical"),
    ("ServiceNotReady", "ready", "==", 0.0, 2, "warning"),
    ("NoModelsLoaded", "models_loaded", "==", 0.0, 5, "critical"),
    ("HighPredictionLatency", "prediction_latency_p95", ">", 0.5, 5, "warning"),
    ("VeryHighPredictionLatency", "prediction_latency_p95", ">", 2.0, 2, "critical"),
    ("HighErrorRate", "error_ratio", ">", 0.05, 5, "warning"),
    ("VeryHighErrorRate", "error_ratio", ">", 0.20, 2, "critical"),
    ("CriticalAnomaliesDetected", "critical_anomalies_5m", ">", 0.0, 0, "critical"),
    ("HighAnomalyRate", "anomalies_15m", ">", 10.0, 0, "warning"),
    ("LowCacheHitRate", "cache_hit_ratio", "<", 0.5, 10, "warning"),
    ("ScaleUpRecommended", "scale_out_5m", ">", 0.0, 0, "info"),
    ("HighMemoryUsage", "memory_ratio", ">", 0.85, 5, "warning"),
    ("HighCPUUsage", "cpu_ratio", ">", 0.85, 5, "warning"),
)

#: autoscaling triggers: workload, trigger, threshold, activation threshold, min and max replicas
SCALING_TRIGGERS = (
    ("shop-api", "cpu_utilization", 0.7, 0.3, 2, 20),
    ("shop-api", "requests_per_second", 100.0, 10.0, 2, 20),
    ("shop-api", "p95_latency", 0.5, 0.2, 2, 20),
    ("shop-api", "predicted_replicas", 1.0, 0.0, 2, 20),
    ("inference", "predictions_per_minute", 50.0, 5.0, 2, 10),
    ("inference", "request_latency", 0.5, 0.1, 2, 10),
    ("inference", "cpu_utilization", 0.7, 0.3, 2, 10),
)

#: preferred target column of a training run
TARGET_CANDIDATES = ("cpu_utilization", "saleor_cpu", "ec2_cpu_utilization", "rps")
