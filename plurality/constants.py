"""Fixed values. They must equal the published study's so that results agree."""

# --- fixed values: classes, partitions, statuses -------------------------------------
CLASS_NAMES = ("Seizure", "LPD", "GPD", "LRDA", "GRDA", "Other")
N_CLASSES = 6
VOTE_COLUMNS = ("seizure_vote", "lpd_vote", "gpd_vote", "lrda_vote", "grda_vote", "other_vote")
PARTITIONS = ("train", "tune", "calibration_t", "calibration_p", "test")
PARTITION_SHARES = (0.60, 0.10, 0.05, 0.05, 0.20)
LOCKED_PARTITIONS = ("test",)
STATUSES = ("PLANNED", "RUNNING", "PASS", "FAIL", "INCOMPLETE", "NOT_RUN", "BLOCKED")
VOTE_BANDS = (("n=1", 1, 1), ("n=2-4", 2, 4), ("n=5-9", 5, 9), ("n>=10", 10, None))
METRIC_FIELDS = (
    "run_id", "method_id", "seed", "split_hash", "preprocess_hash", "protocol_hash", "prediction_hash",
    "metric", "value", "ci_low", "ci_high", "n_rows", "n_patients", "n_components", "status", "reason",
)

# --- fixed values: numerics ----------------------------------------------------------
EPS = 1e-7
LOG_FLOOR = 1e-8
SPLIT_SEED = 20260907
T_MIN, T_MAX = 0.25, 4.0
SMALL_CELL = 10
LOW_SUPPORT_GROUPS = 30

# --- fixed values: temporal geometry and spectra --------------------------------------
SAMPLE_RATE_HZ = 200
WINDOW_SECONDS = 50
CONTEXT_SECONDS = 600
TARGET_SECONDS = (20.0, 30.0)
CONTEXT_CENTER_SECONDS = (295.0, 305.0)
FOVEATED_SEGMENTS = ((0.0, 20.0, 8), (20.0, 30.0, 16), (30.0, 50.0, 8))
FREQUENCY_RANGE_HZ = (0.5, 40.0)
FREQUENCY_BINS = 64
LOCAL_TIME_BINS = 32
CONTEXT_TIME_BINS = 64
SHARD_ROWS = 2048
VALID_FRAME_FRACTION = 0.90
MIN_VALID_LEADS = 2
MIN_BIN_WEIGHT = 0.50
MAX_GAP_SAMPLES = 50
NORMAL_CLIP = 8.0
CACHE_CAP_BYTES = 6_000_000_000
METADATA_BYTES = 250_000_000
BANDS = (("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 40.0))
REGIONS = ("LL", "RL", "LP", "RP")
MONTAGE = {
    "LL": (("Fp1", "F7"), ("F7", "T3"), ("T3", "T5"), ("T5", "O1")),
    "RL": (("Fp2", "F8"), ("F8", "T4"), ("T4", "T6"), ("T6", "O2")),
    "LP": (("Fp1", "F3"), ("F3", "C3"), ("C3", "P3"), ("P3", "O1")),
    "RP": (("Fp2", "F4"), ("F4", "C4"), ("C4", "P4"), ("P4", "O2")),
}
SOURCE_CHANNELS = (
    "Fp1", "F3", "C3", "P3", "F7", "T3", "T5", "O1", "Fz", "Cz", "Pz",
    "Fp2", "F4", "C4", "P4", "F8", "T4", "T6", "O2", "EKG",
)

# --- fixed values: release policy -----------------------------------------------------
ALLOWED_EXTENSIONS = (
    ".py", ".sh", ".md", ".tex", ".bib", ".pdf", ".yaml", ".yml", ".toml", ".cff", ".txt", ".json", ".csv",
    ".ipynb", ".png", ".svg", ".gitignore", ".cfg", ".ini", "",
)
FORBIDDEN_NAMES = ("train.csv", "test.csv", "sample_submission.csv")
FORBIDDEN_EXTENSIONS = (
    ".parquet", ".npy", ".pt", ".safetensors", ".pkl", ".pickle", ".zip", ".h5", ".hdf5", ".log",
)
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_EXPORT_BYTES = 100 * 1024 * 1024
SECRET_PATTERNS = (
    r"ghp_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{30,}",
    r"KGAT_[A-Za-z0-9]{20,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"sk-[A-Za-z0-9]{30,}",
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN (RSA|OPENSSH|EC|DSA) PRIVATE KEY-----",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
)
IDENTIFIER_PATTERN = r"\b(patient_id|eeg_id|spectrogram_id|label_id)\b\s*[:=]\s*\d{5,}"
