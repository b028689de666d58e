"""Fixed values.

Everything in this file is a constant of the data format: code words, column
names, label tables, default sizes and sentence fragments. Results depend on
these exact values, so they are written out plainly and nothing else lives here.
"""

# -- missing-value codes -----------------------------------------------------
INAPPLICABLE_CODE = ".i"
MISSING_CODES = [".n", ".d", ".s", ".r", ".x", ".y", ".z", ".u", ".m", ".b", ".p", ".f"]
PROFILED_CODES = [".i", ".n", ".d"]
SENTINEL = -9
INAPPLICABLE_LABEL = "iap"

# cells that the usual CSV reader of survey people treats as empty
EMPTY_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# -- columns -----------------------------------------------------------------
ID_COLUMN = "id"
ID_AND_WEIGHT_COLUMNS = ["id", "wtssnrps", "wtssps", "wtssnrps_next", "wtssps_next"]
OBJECTIVE_TARGETS = ["income16", "educ"]
OPINION_TARGETS = ["letin1a", "finrela", "marhomo"]
NEAR_DUPLICATES = {"income16": ["income", "coninc", "realinc"], "educ": ["degree"]}

# -- sentence fragments ------------------------------------------------------
PROMPT_PREFIX = "One's data in 2022 GSS data: "
SUFFIX_PREFIX = " So one's "

# -- default sizes -----------------------------------------------------------
FEATURE_COUNTS = [50, 100, 120]
DEFAULT_FEATURE_COUNT = 50
DEFAULT_CANDIDATES = 2000
DEFAULT_TRAIN_CANDIDATES = 1000
DEFAULT_FOLDS = 5
LENGTH_BINS = 40
HEAT_LIMIT = 3
LOSS_IGNORED = -100
PADDING_ID = 0
IRRELEVANT = -9
RELEVANCE_MAP = {2: 1, 1: 1, 0: 1, -1: 1, -2: 1, -9: 0}

# -- training defaults and search space --------------------------------------
TRAINING_DEFAULTS = {"batch_size": 32, "num_epochs": 1, "learning_rate": 1e-3, "cutoff_len": 900}
DEFAULT_WEIGHT_DECAY = 0.01
GRID_EPOCHS = [2, 3, 4]
GRID_LEARNING_RATES = [1e-3]
SEARCH_CHOICES = {
    "weight_decay": [0.01, 0.03, 0.05, 0.1, 0.2],
    "warmup_steps": [20, 40, 50, 60, 100, 200],
    "learning_rate": [5e-5, 1e-4, 2e-4, 3e-4, 5e-4, 1e-3],
    "per_device_train_batch_size": [16, 32, 64],
}
SEARCH_EPOCH_RANGE = (15, 25)

# -- code -> label, by target ------------------------------------------------
TARGET_LABELS = {
    "income16": {
        "1": "under $1,000", "2": "$1,000 to $2,999", "3": "$3,000 to $3,999",
        "4": "$4,000 to $4,999", "5": "$5,000 to $5,999", "6": "$6,000 to $6,999",
        "7": "$7,000 to $7,999", "8": "$8,000 to $9,999", "9": "$10,000 to $12,499",
        "10": "$12,500 to $14,999", "11": "$15,000 to $17,499", "12": "$17,500 to $19,999",
        "13": "$20,000 to $22,499", "14": "$22,500 to $24,999", "15": "$25,000 to $29,999",
        "16": "$30,000 to $34,999", "17": "$35,000 to $39,999", "18": "$40,000 to $49,999",
        "19": "$50,000 to $59,999", "20": "$60,000 to $74,999", "21": "$75,000 to $89,999",
        "22": "$90,000 to $109,999", "23": "$110,000 to $129,999", "24": "$130,000 to $149,999",
        "25": "$150,000 to $169,999", "26": "$170,000 or over",
    },
    "educ": {
        "0": "no formal schooling", "1": "1", "2": "2", "3": "3", "4": "4", "5": "5", "6": "6",
        "7": "7", "8": "8", "9": "9", "10": "10", "11": "11", "12": "12", "13": "13", "14": "14",
        "15": "15", "16": "16", "17": "17", "18": "18", "19": "19", "20": "20",
    },
    "letin1a": {
        "1": "increased a lot", "2": "increased a little", "3": "remain the same as it is",
        "4": "reduced a little", "5": "reduced a lot",
    },
    "finrela": {
        "1": "far below average", "2": "below average", "3": "average",
        "4": "above average", "5": "far above average",
    },
    "marhomo": {
        "1": "strongly agree", "2": "agree", "3": "neither agree nor disagree",
        "4": "disagree", "5": "strongly disagree",
    },
}
