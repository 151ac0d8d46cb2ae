"""Values of the lineage record format that results depend on."""

# Name schemes, prefixes, locations (in lookup order), defaults
# and record constants of the lineage log.
BIGQUERY = "bigquery:"
CUSTOM = "custom:"
GCS = "gcs:"
STORAGE_URI = "gs://"
STORAGE_RESOURCE = "//storage.googleapis.com/"
LOCATIONS = ("us-east1", "us-central1", "us")
UNKNOWN_SOURCE = "Unknown_Source"
UNKNOWN_TARGET = "Unknown_Target"
MISSING_DETAIL = "N/A"
DEFAULT_NAMESPACE = "default"
JOB_ID = "custom_job_id"
NAMESPACE_PROPERTY = "spark.openlineage.namespace"
APP_NAME_PROPERTY = "spark.openlineage.appName"
SPARK_APP_NAME = "spark.app.name"
CUSTOM_ORIGIN = "CUSTOM"
COMPLETED = "COMPLETED"
STORAGE_SYSTEM = "cloud_storage"
ASPECT_FORMAT = "parquet"
ASPECT_FRAMEWORK = "TYDA"

TABLE_LEVEL = "table"
COLUMN_LEVEL = "column"
