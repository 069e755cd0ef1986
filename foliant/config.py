"""Fixed values of the document rules. They must stand as they are for right results."""

# Page layout
MARGIN = 0.08
INDENT_PT, QUOTE_INDENT_TOL = 6.0, 3.0
SHORT_TAIL_PT = 25.0
HEADING_MIN, HEADING_STRONG = 1.08, 1.25
FOOTNOTE_RATIO = 0.85
LETTER_RATIO = 0.70
FULL_WIDTH = 0.6
MIN_IMG_RATIO, MAX_IMG_RATIO = 0.03, 0.60
# Regions
PAD, FIG_PAD, GAP_PT, MIN_HEIGHT = 4.0, 14.0, 15.0, 40.0
MATH_MIN, EQ_WIDTH_MAX, EQ_MIN_HEIGHT, EQ_MIN_CHARS, EQ_DOMINANT = 0.30, 0.7, 8.0, 6, 0.5
MAX_HEIGHT_RATIO, MAX_BELOW_RATIO, MAX_GRAPHIC_RATIO = 0.6, 0.85, 0.60
BODY_LO, BODY_HI, COMMON_SIZE_RATIO, COMMON_SIZE_MAX = 0.90, 1.12, 0.20, 1.20
GROW_GAP, WIDE_RATIO, PROSE_RUN = 40.0, 0.40, 3
OVERLAP_SLACK = 30.0
# Gate and chunks
MIN_COVERAGE, MAX_TRUNCATED = 0.97, 0.05
CHUNK_CHARS = 6000
REPEAT_PAGES, REPEAT_CHARS = 3, 120
COVER_UNITS = 60
MATH_UNIT_MAX = 130

# Sentence ends: of paragraphs, of scores, and of the older stitching
SENT_END = ".!?\"')]”’"
SCORE_END = ".!?:;\"')]”’」』"
STITCH_END = ".!?\"')]“”‘’"

# Patterns (Java; (?U): Unicode classes, (?d): only \n ends a line)
SPACE = r"\s\x1c-\x1f"
#: The characters of (?U)[SPACE] themselves, for trimming.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CAPTION = r"(?i)^(figure|table|그림|표)\s*\d+\s*[.:)]"
TABLE_CAPTION = r"(?iU)^(table|표)\b"
XREF_CLOSE = r"(?i)^(figure|table|그림|표)\s*\d+\s*\)"
WORDISH = r"\p{L}{3,}|[가-힣ㄱ-ㆎ一-鿿]{2,}"
NUMBER_ONLY = r"^[\[\(]?\d{1,4}[\]\)]?$"
MATH_FONT = r"(?i)CM(MI|SY|EX)|MSAM|MSBM|StandardSymL|Symbol|Math"
COVER = r"(?i)jstor|accessibility support|terms and conditions|about\.jstor\.org|is collaborating with|not-for-profit|remediated|all use subject to"
MATH_OP = r"[=≈≤≥∑∏∫→←⇒∂±×÷∼≡∥]"
EQUATION_OP = r"[=≈≤≥∑∏∫→←⇒∂±×÷∼≡]"
EQUATION_NUMBER = r"\(\d{1,2}\)\s*$"
PROSE_WORD = r"[A-Za-z]{4,}"
CONTINUATION = r"^([a-z]|−→|→|⇒|≈|≡|∑|≤|≥|[“‘\"'](?U:\s*)[a-z])"
MD_HEAD = r"^#{1,6}(?U:\s*)"
IMAGE_BLOCK = r"^!\[[^\]]*\]\([^)]*\)$"
IMAGE_LINK = r"!\[[^\]]*\]\(([^)]+)\)"
SKIP_PARAGRAPH = r"(?i)^(figure|table|fig\.|source:|author\(s\):|published by:|stable url:|key:|그림|표\s)"
CHRONOLOGY = r"[A-Z]{1,4}\s?\d{1,3}\s+\d{1,2}/\d{2,4}\b"
CELL = r"^[\"\s]*\*\s"
REFERENCES = r"(?idm)^#*\s*(references|참고문헌|bibliography)\s*$"
GLOSSARY = r"(?idm)^#*\s*용어\s*대응표"
NUMBER_TOKEN = r"[\d.,%$/\[\]()·~-]+"
CITATION = r"\(([A-Z][A-Za-z&.\- ]+?),\s*(\d{4}[a-z]?)\)"
YEAR_OR_DECIMAL = r"(?<![\d.])\d{4}(?![\d.])|(?<![\d.])\d+\.\d+(?![\d.])"
YEAR = r"(?<![\d.])\d{4}(?![\d.])"
INTEGER = r"(?<![\d.])\d+(?![\d.])"
AFFILIATION = r"^>\s*\d+\s+_"
FOOTNOTE_LABEL = r"^>\s*\*\*각주[^*]*\*\*\s*"
HEADING_LINE = r"(?dm)^#{1,6}\s"
SECTION_LINE = r"^#{1,3}\s+\S"
STEM = r"^[^\\/:*?\"<>|]+$"
