"""Word lists, name patterns and null tokens that results depend on."""

# ---- fixed values: null tokens of the usual CSV reader -------------------------------------
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- fixed values: identifier, metadata and text column names -------------------------------
CLEAN_ID = r"(^|_)(id)$|^id_|^(row|index|rowid|passengerid|customerid|userid|recordid)$"
CLEAN_META = r"(timestamp|created_at|updated_at|modified_at|date_added)"

SIMPLE_ID = r"^id$|.*_id$|^id_|.*uuid.*|.*index$|^row"
SIMPLE_META = r".*timestamp.*|.*created.*|.*updated.*"
SIMPLE_TEXT = r".*name$|.*address.*|.*email.*|.*description.*|.*comment.*"

STRICT_ID = r"^id$|.*_id$|^id_.*|.*uuid.*|.*index.*|^row.*num.*|.*serial.*|.*ticket.*|.*ref.*num.*"
STRICT_TEXT = r".*name$|.*address.*|.*email.*|.*phone.*|.*description.*|.*comment.*|.*note.*"
STRICT_META = r".*timestamp.*|.*created.*at.*|.*updated.*at.*|.*date.*|.*time.*"

TYPE_ID = r"(^|_)?id$"
TARGET_ID = r"^id$|_id$|^index$|^row"
GENERIC_NAME = r"^(col|column|var|x|field)[0-9]*$"
GENERIC_FILES = ["data", "dataset", "file", "upload", "test", "123"]

# ---- fixed values: words that mark a target column ------------------------------------------
TARGET_WORDS = [
    "target", "label", "class", "y", "output", "result", "survived", "species", "quality",
    "outcome", "price", "churn", "fraud", "default", "diagnosis", "category", "response",
    "dependent", "predict", "score", "status", "grade", "decision", "flag", "risk", "type", "group",
]
TARGET_WORDS_ENTROPY = [
    "target", "label", "class", "output", "result", "response", "y", "outcome", "flag", "status",
    "survived", "churn", "default", "fraud", "price", "salary", "revenue", "sales", "score",
    "rating", "diagnosis",
]
ID_WORDS_ENTROPY = [
    "id", "uuid", "index", "key", "rownum", "row_id", "name", "email", "phone", "address",
    "zipcode", "timestamp", "date", "time",
]

# ---- fixed values: words that mark a sensitive attribute ------------------------------------
SENSITIVE_WORDS = [
    "age", "gender", "sex", "race", "ethnicity", "religion", "nationality", "disability",
    "income", "education", "zipcode", "postcode", "marital",
]

# ---- fixed values: title groups for passenger-style names -----------------------------------
TITLE_PATTERN = r" ([A-Za-z]+)\."
TITLE_GROUPS = {
    "Mr": "Mr", "Miss": "Miss", "Mrs": "Mrs", "Master": "Master", "Dr": "Rare", "Rev": "Rare",
    "Col": "Rare", "Major": "Rare", "Mlle": "Miss", "Mme": "Mrs", "Ms": "Miss",
    "Countess": "Rare", "Lady": "Rare", "Sir": "Rare", "Capt": "Rare", "Don": "Rare",
    "Jonkheer": "Rare",
}
AGE_EDGES = [0, 12, 18, 35, 60, 120]
