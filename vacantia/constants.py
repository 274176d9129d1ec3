"""Values that are part of the data format or of the result, in one place."""

# --- fixed values: formats of the published listings and snapshot files ---
SNAPSHOT_GLOB = "vacancies_*.txt.gz"
DATED_LINE_PATTERN = r"\d{2}/\d{2}/\d{4}$"
GATE_LINES = 10
CODE_PATTERN = r"^\d+"
PUBLICATION_PATTERN = r"Fecha de Publicación (\d{2}/\d{2}/\d{4})"
PUBLICATION_FORMAT = "dd/MM/yyyy"
WAGE_CATEGORY_PATTERN = r"\$[\d.]+\s*-\s*\$[\d.]+|A Convenir"
WAGE_MIDPOINT_PATTERN = r"^\$(\d+[\.,\d]*) - \$(\d+[\.,\d]*)"
WAGE_TRIPLET_PATTERN = r"(\d+)\s+(\d+)\s+(\d+)"
WAGE_LABEL_PATTERN = r"(\d+)-(\d+)"
TO_BE_AGREED = "a convenir"
TO_BE_AGREED_RAW = "A Convenir"
NOT_SPECIFIED = "Not Specified"
WAGE_PROVIDED = "Wage Provided"
TOKEN_PATTERN = r"^[a-zA-Z]+$"
PHRASE_PATTERN = r"^[a-zA-Z]+(?: [a-zA-Z]+)?$"
# --- end of fixed values ---

# --- fixed values: default thresholds ---
MIN_BATCH_ROWS = 10_000
MIN_UNIGRAM_COUNT = 15
LIFT_THRESHOLD = 2.0
MIN_DOCUMENT_FREQUENCY = 10
MIN_VALID_SHARE = 0.8
FOLDS = 5
FOLD_SEED = 42
DISCOVERY_RANGE = (0.05, 0.25)
BASE_MARK_SIZE = 14
# --- end of fixed values ---
