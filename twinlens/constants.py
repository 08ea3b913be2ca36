"""Fixed values. Every number, name or text here has to equal the published
behaviour for the results to be right, so they are stated once, as they are."""

# Acceptance gate of the scorecard.
MAX_WASSERSTEIN = 0.15
MAX_UTILITY_DROP = 20.0
MAX_ATTACK_ACCURACY = 0.76
MIN_K_ANONYMITY = 3
MAX_ROUNDS = 3

# Colour bands of the per-column Wasserstein report.
BAND_PASS = 0.05
BAND_AMBER = 0.15

# Column rules.
JUDGE_ID_NAMES = ("patient_id", "account_id", "record_id", "user_id", "id")
JUDGE_UNIQUE_RATIO = 0.9
METRIC_ID_KEYWORDS = (
    "_id", "id_", "patient_id", "record_id", "index",
    "uuid", "key", "rownum", "row_num", "seq",
)
METRIC_UNIQUE_RATIO = 0.95
METRIC_UNIQUE_MIN_ROWS = 20
ATTACK_ID_NAMES = ("patient_id", "account_id", "record_id", "id")
NOISE_ID_NAMES = ("patient_id", "account_id", "id")
TARGET_NAMES = ("readmitted", "is_fraud", "fraud", "outcome", "label", "target")

# Numeric guards.
RANGE_FLOOR = 1e-6
KL_FILL = 1e-10
WEIGHT_FLOOR = 1e-6

# Privacy.
DEFAULT_EPSILON = 1.0
DEFAULT_DELTA = 1e-5
NOISE_MIN_DISTINCT = 2
MATCH_MIN_DISTINCT = 5
RISK_EPSILON = {"critical": 0.1, "high": 0.1, "medium": 1.0, "low": 10.0, "public": 10.0}

# Modelling.
TEST_SHARE = 0.3
UTILITY_MIN_ROWS = 10
UTILITY_FAILED_DROP = 100.0
ATTACK_TREES = 100
ATTACK_DEPTH = 5
ATTACK_FOLDS = 5
ATTACK_MIN_ROWS = 20
ATTACK_FALLBACK = 0.5
DEFAULT_SEED = 42
KDE_POINTS = 300
KDE_MARGIN = 0.1
QUANTILE_POINTS = 1000

# Requests.
DEFAULT_ROWS = 500
MIN_COLD_START_ROWS = 200
GOAL_LENGTH = 100

# Seed history of the model recommender.
HISTORY_SEED = (
    ("healthcare_tabular", "TVAE", "tabular", "Healthcare",
     "High-dimensional healthcare records with mixed types."),
    ("finance_timeseries", "TimeGAN", "time-series", "Finance",
     "Sequential financial transaction data with temporal correlations."),
    ("general_tabular", "GaussianCopula", "tabular", "General",
     "General-purpose low-dimensional tabular data."),
)
FALLBACK_MODEL = "GaussianCopula"

# Candidate synthesizers by the user's choice of model family.
MODEL_FAMILIES = {
    "timegan": ("CTGAN", "TVAE"),
    "vae": ("TVAE", "GaussianCopula"),
    "diffusion": ("CTGAN", "TVAE"),
    "auto": ("CTGAN", "TVAE", "GaussianCopula"),
}
MODEL_MIN_ROWS = {"CTGAN": 50, "TVAE": 20, "GaussianCopula": 10}

# Industry field lists.
FHIR_FIELDS = ("patient_id", "timestamp", "observation_code", "value")
FHIR_STANDARD = "FHIR R4 (Observation Resource)"
BASEL_FIELDS = ("exposure_at_default", "probability_of_default", "loss_given_default")
BASEL_STANDARD = "Basel III (Credit Risk Framework)"

# Healthcare priors: diagnosis, weight, age mean/sd, cost mean/sd, blood pressure mean.
DIAGNOSES = (
    ("Hypertension", 46, 58, 12, 250, 120, 148),
    ("Type 2 Diabetes", 39, 52, 13, 380, 180, 128),
    ("Coronary Artery Disease", 30, 63, 10, 5200, 2000, 135),
    ("Asthma", 27, 35, 18, 175, 80, 118),
    ("Osteoarthritis", 34, 64, 11, 750, 300, 125),
    ("Chronic Kidney Disease", 27, 61, 12, 3800, 1500, 132),
    ("Heart Failure", 36, 68, 10, 7500, 3000, 138),
    ("COPD", 35, 64, 11, 1200, 500, 126),
    ("Depression", 31, 40, 15, 300, 150, 118),
    ("Lupus", 29, 36, 12, 2200, 1000, 122),
    ("Rheumatoid Arthritis", 38, 52, 13, 1800, 800, 124),
    ("Hypothyroidism", 36, 48, 15, 125, 60, 120),
    ("Obesity", 27, 42, 14, 450, 200, 130),
    ("Atrial Fibrillation", 24, 66, 10, 3000, 1200, 135),
    ("Stroke", 41, 67, 11, 12000, 4000, 142),
)
MALE_SHARE = 0.48
SMOKER_SHARE = 0.25

# Finance priors.
TRANSACTION_TYPES = (
    ("Purchase", 0.35), ("Withdrawal", 0.15), ("Transfer", 0.15), ("Payment", 0.15),
    ("Refund", 0.05), ("Deposit", 0.10), ("Fee", 0.05),
)
MERCHANTS = (
    "Grocery", "Restaurant", "Travel", "Healthcare",
    "Entertainment", "Retail", "Utilities", "Online",
)
FRAUD_HOURS = (1, 2, 3, 23, 0)
FRAUD_SHARE = 0.05
FOREIGN_SHARE = 0.08
