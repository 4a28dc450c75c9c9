"""Word lists, patterns, constants and texts that decide results.

They are stated here as data because any other value would give other answers.
"""

# --- fixed values: keyword scoring -------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
BM25_TOP_K = 20
DENSE_TOP_K = 20
CANDIDATES_PER_PICK = 3
MMR_LAMBDA = 0.6
RETRIEVE_MMR_LAMBDA = 0.65
RETRIEVE_TOP_K = 6
ANALYTICAL_TOP_K = 8

# --- fixed values: question types ---------------------------------------------------
ANALYTICAL_PATTERNS = [
    r"\b(average|mean|median|sum|total|count|max|min|maximum|minimum|how many|percentage|ratio|trend)\b",
    r"\b(compare|comparison|difference|versus|vs\.?|ranking|top \d+|bottom \d+)\b",
    r"\b(distribution|correlation|group by|breakdown|analysis|statistics)\b",
]
LOOKUP_PATTERNS = [
    r"\b(what is|what are|who is|find|show|list|display|get|fetch|look up|search for)\b",
    r"\b(value|record|entry|row|column|field)\b",
]

# --- fixed values: files ---------------------------------------------------------------
SEPARATORS = [",", ";", "|", "\t", " "]
SNIFF_LINES = 20
RECORD_KEYS = ["data", "records", "results", "items", "rows"]
TABLE_NAME_LENGTH = 40
# The letters of code page 1252 at the control codes 0x80 to 0x9F of Latin-1; five of these codes stand for nothing.
CP1252_CODES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_LETTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: cleaning and profiling ---------------------------------------------
NUMERIC_SHARE = 0.8
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_PATTERN = r"^[+-]?\d+$"
SAMPLE_VALUES = 5
TOP_VALUES = 5
TEXT_COLUMNS_SUMMARISED = 5
SAMPLES_SHOWN = 3
OVERVIEW_COLUMNS = 20

# --- fixed values: chunk sizes ----------------------------------------------------------
MAX_VALUE_LENGTH = 200
WIDE_TABLE_COLUMNS = 30
WIDE_TABLE_ROWS = 200
LARGE_TABLE_ROWS = 500
MEDIUM_TABLE_ROWS = 100
DEFAULT_PARAMETERS = {
    "row_window": {"window": 10, "overlap": 2},
    "column_group": {"row_sample": 20, "group_size": 8},
    "hybrid": {"window": 8, "overlap": 1, "group_size": 6},
}

# --- fixed values: memory and prompts -------------------------------------------------
MEMORY_MESSAGES = 16
NO_CONTEXT = "No relevant data found in the database."
CONTEXT_SEPARATOR = "\n\n---\n\n"
DEFAULT_QUESTIONS = [
    "What are the main trends in this data?",
    "Show me the top 5 entries.",
    "What is the average value?",
    "How many unique categories are there?",
    "What is the most common value?",
]
