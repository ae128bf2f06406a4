"""Fixed values of the practice domain, stated once."""

# Results depend on these numbers, patterns and names.
LONG_SENTENCE_WORDS = 12
MAX_COUNTER = 999
MAX_TEXT = 6000
BATCH_SIZE = 20
CONTRACT = "sentence-practice-v1"
LEGACY_CONTRACT = "legacy-v1"
WORKBOOK_KEY = "sentence-practice"
#: Chips of a sentence: words with inner apostrophes, separators or dashes, currency signs and percent.
TOKEN_PATTERN = r"(?:[$€£₩¥#])?[\p{L}\p{M}\p{N}]+(?:[’'][\p{L}\p{M}\p{N}]+|[.,/‐‑‒–—−-][\p{L}\p{M}\p{N}]+)*%?"
DASHES = "‐‑‒–—−"
#: White space in the wide sense, as a regex class.
WIDE_SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters one by one.
WIDE_SPACE_CHARACTERS = " \t\n\x0b\x0c\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
UUID4_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
HARD_TAXONOMIES = ("paragraph_order", "sentence_insertion", "grammar_multi_error", "implication", "summary_two_blank")
EASY_TAXONOMIES = ("content_true", "content_false", "unanswerable", "main_idea", "topic", "title")
FAILURE_WINDOW_MINUTES = 15
TOUCH_MINUTES = 5
#: Failures of an identifier in the window from which on its tries are blocked.
LOGIN_LIMITS = {"code": 5, "student_client": 30, "admin_client": 5, "admin": 50}
#: What marks the textbook whose lessons are told by number, and its lessons by what names them.
TEXTBOOK_MARKS = ("공통영어2", "민병천")
LESSON_NAMES = {1: r"(?i)(lesson\s*1([^0-9]|$)|(^|[^0-9])1\s*과)", 2: r"(?i)(lesson\s*2([^0-9]|$)|(^|[^0-9])2\s*과)"}
# End of fixed values.
