"""Fixed values.

Everything in this module has to equal an outside convention for results to be
right: code-point ranges, template texts, lookup tables, default parameters.
Nothing here is logic.
"""

# --- fixed values: packing, windows, instruction examples ---------------------
SHARD_TOKENS = 100_000_000
WINDOW_TOKENS = 1024
SEQUENCE_TOKENS = 1025
MIN_RESPONSE_TOKENS = 32
ROWS_PER_SHARD = 2048
SOURCE_CAP = 15_000
HOLDOUT_FRACTION = 0.05
MIX_SEED = 1337
SERVE_SEED = 1337
SFT_SERVE_SEED = 42
SAMPLE_SEED = 42
SAMPLE_PER_SOURCE = 3
TOKEN_ID_LIMIT = 65536
CONTIGUOUS_TRAIN_FRACTION = 0.9
VALIDATION_BATCHES = 20

# --- fixed values: learning-rate schedules ------------------------------------
PRETRAIN_SCHEDULE = {
    "max_lr": 2.4e-3,
    "min_lr": 2.4e-4,
    "warmup_steps": 357,
    "max_steps": 40_000,
}
SFT_SCHEDULE = {"max_lr": 2e-5, "min_lr": 2e-6, "warmup_steps": 200}
TOTAL_BATCH_TOKENS = 524_288
PEAK_FLOPS = 209.5e12

# --- fixed values: language filter --------------------------------------------
MIN_TEXT_CHARS = 10
MIN_ASCII_RATIO = 0.90
LANGUAGE_SAMPLE_CHARS = 2000

# Scripts of which one character is enough to reject a text.
NON_LATIN_RANGES = [
    (0x0400, 0x052F),  # Cyrillic, Cyrillic Supplement
    (0x0590, 0x05FF),  # Hebrew
    (0x0600, 0x06FF),  # Arabic
    (0x0700, 0x074F),  # Syriac
    (0x0900, 0x097F),  # Devanagari
    (0x0980, 0x09FF),  # Bengali
    (0x0A00, 0x0A7F),  # Gurmukhi
    (0x0A80, 0x0AFF),  # Gujarati
    (0x0B00, 0x0B7F),  # Oriya
    (0x0B80, 0x0BFF),  # Tamil
    (0x0C00, 0x0C7F),  # Telugu
    (0x0C80, 0x0CFF),  # Kannada
    (0x0D00, 0x0D7F),  # Malayalam
    (0x0E00, 0x0E7F),  # Thai
    (0x0E80, 0x0EFF),  # Lao
    (0x1000, 0x109F),  # Myanmar
    (0x10A0, 0x10FF),  # Georgian
    (0x1100, 0x11FF),  # Hangul Jamo
    (0x3040, 0x30FF),  # Hiragana, Katakana
    (0x3400, 0x4DBF),  # CJK Extension A
    (0x4E00, 0x9FFF),  # CJK Unified Ideographs
    (0xAC00, 0xD7AF),  # Hangul Syllables
    (0xF900, 0xFAFF),  # CJK Compatibility Ideographs
    (0xFB50, 0xFDFF),  # Arabic Presentation Forms-A
]

# What Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: prompt template --------------------------------------------
INSTRUCTION_MARK = "### Instruction:\n"
INPUT_MARK = "### Input:\n"
RESPONSE_MARK = "### Response:\n"
INPUT_HEAD = "### Input:"
RESPONSE_HEAD = "### Response:"
HUMAN_MARK = "### Human:"
ASSISTANT_MARK = "### Assistant:"
SYSTEM_PREFIX_MIN_CHARS = 10
END_OF_TEXT = "<|endoftext|>"

# --- fixed values: multiple-choice benchmarks ---------------------------------
SUBJECT_PROMPT_HEAD = "The following are multiple choice questions (with answers) about"
ANSWER_PROMPT = "Answer:"
CHOICE_LETTERS = ["A", "B", "C", "D"]
FALLBACK_LABELS = {
    "A": 0, "B": 1, "C": 2, "D": 3, "E": 4,
    "1": 0, "2": 1, "3": 2, "4": 3, "5": 4,
}
CURATED_SUBJECTS = [
    "high_school_psychology",
    "high_school_us_history",
    "high_school_world_history",
    "high_school_geography",
    "high_school_government_and_politics",
    "management",
    "marketing",
    "miscellaneous",
    "sociology",
    "public_relations",
    "human_aging",
    "nutrition",
]

# --- fixed values: metric logs ------------------------------------------------
PRETRAIN_LOG_COLUMNS = [
    "step", "train_loss", "val_loss", "hellaswag", "mmlu", "arc",
    "lr", "grad_norm", "tokens_per_sec", "mfu", "dt_ms",
]
SFT_LOG_COLUMNS = [
    "step", "train_loss", "val_loss", "lr", "grad_norm", "tokens_per_sec", "dt_ms",
]
STREAM_OF_COLUMN = {
    "train_loss": "train",
    "val_loss": "val",
    "hellaswag": "hella",
    "mmlu": "mmlu",
    "arc": "arc",
    "lr": "lr",
    "grad_norm": "grad_norm",
    "tokens_per_sec": "tokens_per_sec",
    "mfu": "mfu",
    "dt_ms": "dt_ms",
}
# How each log column is written: (digits, scientific notation).
LOG_FORMATS = {
    "train_loss": (6, False),
    "val_loss": (4, False),
    "hellaswag": (4, False),
    "mmlu": (4, False),
    "arc": (4, False),
    "lr": (6, True),
    "grad_norm": (4, False),
    "tokens_per_sec": (2, False),
    "mfu": (6, False),
    "dt_ms": (2, False),
}

# Published scores of two model families by size; the loss is the first family's.
PUBLISHED_BASELINES = [
    ("124M", "val", "first", 3.29),
    ("350M", "val", "first", 2.90),
    ("774M", "val", "first", 2.70),
    ("1558M", "val", "first", 2.60),
    ("124M", "hella", "first", 0.294),
    ("350M", "hella", "first", 0.430),
    ("774M", "hella", "first", 0.485),
    ("1558M", "hella", "first", 0.638),
    ("124M", "hella", "second", 0.337),
    ("350M", "hella", "second", 0.436),
    ("774M", "hella", "second", 0.511),
    ("1558M", "hella", "second", 0.598),
]
