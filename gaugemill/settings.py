"""Thresholds, labels and names the results depend on."""

INCOMING_EVAL_FRACTION = 0.3
INCOMING_SPLIT_SALT = "incoming-holdout"
HASH_BUCKETS = 10_000

REFERENCE_SPLIT = "reference"
CURRENT_SPLIT = "current"
DATASET_NAME = "UCI Drug Review Dataset"
DATASET_SLUG = "jessicali9530/kuc-hackathon-winter-2018"
DATE_FORMAT = "%d-%b-%y"
MISSING_CATEGORY = "__MISSING__"

MAX_MISSING_RATE = 0.01
MAX_KS = 0.02
MAX_TVD = 0.05
PSI_BINS = 10
PSI_EPSILON = 1e-6
PSI_MODERATE = 0.10
PSI_SIGNIFICANT = 0.25
NO_DRIFT_EXIT_CODE = 64

POSITIVE_RATING_FLOOR = 7
NEGATIVE_RATING_CEILING = 4
MIN_TRAINING_ROWS = 1000
MAX_FEATURES = 100_000
RANDOM_SEED = 0

MIN_BASELINE_MARGIN = 0.20
MIN_INVARIANCE_AGREEMENT = 0.95
INVARIANCE_SAMPLE_SIZE = 500
MIN_NEGATION_SHIFT = 0.15
NEGATION_SAMPLE_SIZE = 200
NEGATION_CONFIDENCE = 0.9
EVALUATION_SAMPLE_SIZE = 3000
NEGATION_PREFIXES = ("I disagree, ", "Not really - ", "On the contrary, ")

PROMOTION_MIN_MARGIN = 0.01
RETRAIN_COOLDOWN_SECONDS = 3600

RAW_COLUMNS = ("uniqueID", "drugName", "condition", "review", "rating", "date", "usefulCount")

FLOW_VERSION_TAG = "flow_version_id"
TRAINING_FLOW_NAME = "drug-review-training"
TRAINING_EXPERIMENT = "drug-review-sentiment"
MONITORING_EXPERIMENT = "drug-review-monitoring"
SELECTION_EXPERIMENT = "drug-review-selection"
AB_EXPERIMENT = "drug-review-abtest"
ADAPTATION_EXPERIMENT = "drug-review-adaptation"
COMPONENTS_EXPERIMENT = "drug-review-components"
