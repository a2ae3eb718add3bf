"""Patterns, word lists and constants that decide results. All patterns are used case-insensitively."""

# Section headings, first match wins.
SECTION_PATTERNS = (
    r"^Neutral\s+Open\s+SPPR",
    r"^PROCESS:\s*(.+)",
    r"^(SM\d+_[A-Z])\s+Functional\s+Testing",
    r"^(SM\d+)\s+(.+Testing)",
    r"^(SM\d+)\s+Functional\s+Testing",
    r"^Process:\s+Functional\s+Testing\s+(SM\d+)",
    r"^PROCESS\s*:\s*Functional\s+Testing\s+DSMR",
    r"^Functional\s+Testing\s+table\s+for\s+(\w+)",
    r"^For\s+(MG\d+[A-Z]+)\s+product",
    r"^(DMS\d+)",
    r"^(MG\d+[A-Z]+)(?:\s+product|:|\s+Functional|\s+CRITICALITY|\s+\(.+Testing)",
    r"^PROCEDURE\s+FOR\s+(.+?):",
    r"FUNCTIONAL\s+TEST\s+PROCEDURE\s+FOR\s+([A-Z0-9][A-Z0-9_]{2,})",
    r"^([A-Z0-9][A-Z0-9_]{2,})\s+(?:AUTOMATED\s+)?FUNCTIONAL\s+TESTING",
    r"([A-Z]{2,})PROCESS\s*:\s*Functional",
    r"PROCESS\s*:\s*Functional\s+Testing\s+([A-Z0-9][A-Z0-9_]{2,})",
)
FORCE_SPLIT_PATTERNS = (
    r"^PROCESS:\s*(.+)",
    r"^PROCEDURE\s+FOR\s+(.+?):",
    r"^For\s+(MG\d+[A-Z]+)\s+product",
)

# Model codes.
MODEL_CODE = (
    r"SM\d+(?:_[A-Z0-9]+)?|DMS\d+(?:_[A-Z0-9]+)?|DSMR|SPPR|MAG\d+[A-Z0-9]+|MAC\d+[A-Z0-9]+|MG[A-Z0-9]{3,}"
    r"|[A-Z]{2,6}\d+[A-Z0-9_]*"
)
SCOPE_CODE = r"MAG\d+[A-Z0-9]+|MAC\d+[A-Z0-9]+|SM\d+_[A-Z]|SM\d+"
BLOCK_CODE = r"[A-Z]{2,6}\d+[A-Z0-9]*"
VARIANT_CODE = r"(?=[A-Z]*[0-9])[A-Z][A-Z0-9]{3,9}"

STOP_WORDS = (
    "THE", "AND", "FOR", "WITH", "FROM", "THIS", "THAT", "NOT", "ARE", "WAS", "HAS", "HAD", "WILL", "CAN", "ALL", "BUT", "THEY", "BEEN", "HAVE",
    "EACH", "WHICH", "THEIR", "SAID", "USE", "USED", "VOLTAGE", "CURRENT", "PROCESS", "FUNCTIONAL", "SETTING", "SETTINGS", "TABLE", "PHASE",
    "THRESHOLD", "PROCEDURE", "TESTING", "TEST", "HEALTHY", "FAULT", "DELAY", "STATUS", "LED", "RELAY", "CONDITION", "OFF", "DIP", "SWITCH",
    "SWITCHES", "CHECK", "POINT", "STEP", "REFER", "NOTE", "PAGE", "DOCUMENT", "SCOPE", "REV", "DATE",
)

# Segmentation.
MIN_BLOCK_SIZE = 400
MIN_MERGE_SIZE = 1500
TABLE_SPEC = r"TABLE\s*\d?\s*\(PRODUCT\s*SETTINGS|Under\s*Voltage\s*\(UV\).*?\d+\s+to\s+\d+\s+VAC"
DANGLING_REFERENCE = (
    r"REFER\s+(?:THE\s+)?(?:FOLLOWING\s+)?TABLES?|(?:TABLE|TABLES)\s+(?:BELOW|GIVEN|1|2|01|02)|AS\s+PER\s+TABLE"
)
# Lines in capitals of which a dangling reference can have a part, if it is broken over lines too.
DANGLING_PART = r"REFER|TABLE|(?:AS|PER|THE|FOLLOWING)\z|^(?:PER|THE|FOLLOWING|BELOW|GIVEN|0?[12])"
TABLE_STRUCTURE = r"TABLE\s+\d+\s*\(|TABLE\s+\(|TABLE\s+0\d\s*:"

# Table pages.
TABLE_KEYWORDS = ("TABLE", "PRODUCT SETTINGS", "ACCEPTABLE LIMITS", "VOLTAGE", "CUT OFF", "THRESHOLD")
PROCEDURE_TERMS = ("PROCEDURE", "STEP", "TEST PROCEDURE", "DIP S/W", "HEALTHY CONDITION")

# Page classes.
SPEC_PAGE = r"TABLE|PRODUCT\s*SETTINGS|ACCEPTABLE\s*LIMITS|REF\.?\s*VOLTAGE"
PROCEDURE_PAGE = (
    r"PROCEDURE|PROCESS\s*:|FUNCTIONAL\s+TEST|DIP\s*S/W|TEST\s+PROCEDURE|CHECK\s+POINT|[A-F]\]\s*Goal\s*:"
    r"|LV\s+cut\s*off|HV\s+cut\s*off"
)
NUMBERED_STEP = r"(?m)^\s*\d+\.\s+[A-Z]"
OTHER_PROCESS = r"PROCESS\s*:\s*(?:PRODUCT\s+LABELLING|CLEANING\s*&\s*PACKING|FACTORY\s+SETTING)"
TEST_CONTENT = (
    r"healthy\s+condition|faulty\s+condition|UV.*LED|OV.*LED|ASY.*LED|PWR.*LED|R\s+LED|LED.*ON|LED.*OFF"
    r"|DIP\s+S/W\s+(?:setting|Number)|FUNCTIONAL\s+TEST\s+PROCEDURE|TEST\s+PROCEDURE\s+FOR"
    r"|PROCESS\s*:\s*(?:Functional|Power\s+ON\s+test)|relay\s+(?:status|trips?|ON|OFF)|Cut[\s\-]?Off"
    r"|Low\s+voltage\s+cut|High\s+voltage\s+cut|Symmetrically\s+(?:reduce|increase)|fault\s+recovery"
    r"|indication\s+of\s+fault|[A-F]\]\s*Goal\s*:|LV\s+cut\s*off|HV\s+cut\s*off|R\s*\(RED\s*LED\)|RED\s*LED\s*turns"
)
CUTOFF_HEADING = r"PROCEDURE\s+FOR\s+CAT\s+ID.*R\s*LED"
PAGE_CAP = 8

# Grids.
PARAMETER_NAMES = {
    "UV RANGE": "uv_range",
    "OVER VOLTAGE": "ov_range",
    "OV RANGE": "ov_range",
    "UNDER VOLTAGE": "uv_range",
    "REF VOLTAGE": "ref_voltage",
    "REFERENCE VOLTAGE": "ref_voltage",
    "ON DELAY": "on_delay",
    "OFF DELAY": "off_delay",
}
GENERIC_HEADER_WORDS = (
    "VAC", "LED", "TABLE", "VOLTAGE", "PHASE", "PROCESS", "TEST", "REF", "SEC", "MIN", "DELAY", "SETTING", "SETTINGS", "RANGE", "LIMIT", "LIMITS",
    "STATUS", "RELAY", "SWITCH", "POWER",
)
NOT_APPLICABLE = ("NA", "-", "N/A")
WEAK_VALUES = ("NA", "-", "null")

# Specs and steps.
SPEC_FIELDS = (
    "ref_voltage", "uv_range", "uv_threshold_pct", "ov_range", "ov_threshold_pct", "uv_hysteresis", "ov_hysteresis", "asymmetry", "on_delay",
    "off_delay", "phase_fail", "phase_reverse", "neutral_fail", "virtual_neutral", "lv_cutoff", "hv_cutoff", "voltage_unit", "notes",
)
MARKER_STEP = r"^(supply\s+couple|supply\s+off|run\s+time\s+dip)"
SECTION_LABEL = (
    r"^(?:Under|Over)\s+Voltage|^Phase\s+(?:asymmetry|fail)\s+(?:and|functionality)|^Fix\s+(?:Under|Over)\s+voltage"
    r"|^(?:UV|OV)\s+(?:and\s+)?hysteresis\s+test|^Phase\s+fail\s+and|^DIP\s+S/W\s+functionality"
)
SQRT3 = 1.73205
PHASE_STEPS = ("phase fail", "phase recovery", "phase reverse", "phase reverse recovery")
RECOVERY_STEPS = ("hystersis recovery", "hysteresis recovery", "phase asymmetry recovery", "asymmetry recovery")
MIN_STEPS, MAX_STEPS, EXPECTED_STEPS = 24, 60, 28
SPURIOUS_SECONDS = 62
SECTION_A_UV_PERCENT = 8
WIDE_OV_PERCENT = 22

# Quality.
RANGE = r"(\d+(?:\.\d+)?)\s*[A-Za-z]*\s*(?:to|TO|-|–|—|±)\s*(\d+(?:\.\d+)?)"
PERCENT = r"^\d+(\.\d+)?%\s*(\(.+\))?$"
TIME_WORDS = r"sec|ms|millisecond|min|instant|continuous"
TIME_SUFFIX = r"\d+(?:\.\d+)?\s*[smh]\b"
DEFAULT_LEDS = ("PWR", "UV", "OV", "ASY")

# Limit tables.
ALL_CHECKS = (
    "pad_trim_ban", "unreadable_header", "non_model_column", "value_fragment", "split_header", "cross_source_prefix_vote",
)
PLACEHOLDER_COLUMN = r"^Column[_\s]?\w*$"
NON_MODEL_COLUMN = r"^[\d.]+\s*(VAC|VAC\s*P-?N|V|Hz|A|W|mA)?$"
BRAND_SUFFIX = r"\s*\([A-Za-z\s]+\)\s*$"
VALUE_SUFFIX = r"[%()±+]|\d|\+/?-"
SPLIT_HEADER = r"\s+[\d.%()±+\-]+"

# Comparison.
PASS_PERCENT = 90.0
WRONG_SAMPLES, MISSING_SAMPLES, EXTRA_SAMPLES = 50, 30, 30

# What procedure pages say (fixed patterns, shared by the step rules and the SQL that checks them).
COUPLE_VOLTAGE = r"(?i)symmetrically\s+reduce\b.*?\b(\d+)\s*V\b|\bcouple\b.*?\b(\d+)\s*V\b"
RESET_HYSTERESIS = r"(?i)reset\s+hysteresis\s*(?:voltage\s*)?(?:should\s+be\s*)?(?:in\s+the\s+range\s+of\s*)?(\d+(?:\.\d+)?)\s*V?\s*(?:to|and|-)\s*(\d+(?:\.\d+)?)\s*V"
TRIP_RANGE = r"range of (\d+(?:\.\d+)?)\s*V?\s*(?:to|-)\s*(\d+(?:\.\d+)?)\s*V"
LOW_CUTOFF_BOTH = r"(?is)Low voltage cut off.*?(\d+)\s*V\s*to\s*(\d+)\s*V\s+(\d+)\s*V\s*to\s*(\d+)\s*V"
LOW_CUTOFF = r"(?is)Low voltage cut off.*?(\d+)\s*V\s*to\s*(\d+)\s*V"
HIGH_CUTOFF = r"(?is)High voltage cut off.*?(\d+)\s*V\s*to\s*(\d+)\s*V"
ASYMMETRY = r"(?is)Fix Phase Asymmetry.*?(\d+)\s*%.*?to\s*(\d+)\s*%.*?(\d+)\s*%.*?to\s*(\d+)\s*%"
