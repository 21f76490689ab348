"""Fixed vocabularies and id patterns of the data model."""

# They must equal the published schema 1.2 for results to agree.
SCHEMA_VERSION = "1.2"
DERIVED_TYPES = ("train", "test")
CHALLENGE_TYPES = ("same_slice", "cross_slice_same_subject", "cross_subject")
MERGE_POLICIES = ("preserve", "intersection", "union", "reference")
PREDICTION_STATUSES = ("Source", "Predicted", "Mixed", "Uncertain")
SPATIAL_UNITS = ("cell", "nucleus", "spot", "bin", "region")
COORDINATE_UNITS = ("micrometer", "millimeter", "pixel", "array_index")
MODALITY_NAMES = ("rna", "protein", "atac", "histone", "methylation", "metabolite", "lipid")
VALUE_TYPES = (
    "counts",
    "binary",
    "intensity",
    "normalized",
    "log_normalized",
    "background_corrected_intensity",
    "accessibility_score",
    "unknown",
)
HIERARCHY_COLUMNS = (
    "sample_id",
    "source_dataset_id",
    "donor_id",
    "donor",
    "subject_id",
    "subject",
    "slice_id",
    "slice",
    "tissue",
    "platform",
    "organism",
)
EVENT_METRICS = {
    "page_view": "page_views",
    "catalogue_search": "searches",
    "database_detail_view": "database_details",
    "challenge_detail_view": "challenge_details",
    "download": "downloads",
}
AUTOMATION_PATTERN = (
    "(?i)bot|spider|crawler|slurp|curl|wget|python-requests|python-httpx|"
    "headless|monitoring|uptime"
)
EXCLUDED_ONTOLOGY_IDS = ("unknown", "CL:0000000")
AUXILIARY_ID_PATTERN = "^[a-z0-9][a-z0-9_-]{0,63}$"
DATASET_ID_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
SHA256_PATTERN = "^[0-9a-f]{64}$"
ONTOLOGY_ID_PATTERN = "^CL:[0-9]{7}$"
COLOUR_PATTERN = "^#[0-9A-Fa-f]{6}$"
SAFE_NAME_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._-]*$"
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
