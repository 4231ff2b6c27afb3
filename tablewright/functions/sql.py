"""SQL text of the cell-level functions.

Each builder takes SQL text for a value and returns SQL text, so that one
definition serves the DataFrame form (``F.expr``) and the emitted SQL form.
"""

from __future__ import annotations

# Characters and tokens the inference and the cleaners share.
CURRENCY_SYMBOLS = "£$€¥ "
BOOLEAN_TRUE = ("1", "true", "yes", "t")
BOOLEAN_FALSE = ("0", "false", "no", "f")
DATE_PATTERNS = (
    ("YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}$"),
    ("DD/MM/YYYY", r"^\d{2}/\d{2}/\d{4}$"),
    ("DD-MM-YYYY", r"^\d{2}-\d{2}-\d{4}$"),
    ("DDMMYYYY", r"^\d{8}$"),
    ("unix_epoch", r"^\d{10}$"),
)

# Spark's string literals know no escape for vertical tab and form feed.
WHITESPACE = r"' \t\n\r\u000B\u000C'"
FLOAT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
FLOAT_OR_NAN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(values) -> str:
    return ", ".join(literal(v) for v in values)


def stripped(value: str) -> str:
    """White space off both ends."""
    return f"btrim({value}, {WHITESPACE})"


def currency_text(value: str) -> str:
    """Leading currency symbols and thousands commas removed."""
    return f"replace(trim(LEADING '{CURRENCY_SYMBOLS}' FROM {value}), ',', '')"


def currency_number(value: str) -> str:
    text = currency_text(value)
    return f"CASE WHEN {text} RLIKE r'{FLOAT}' THEN try_cast({text} AS DOUBLE) END"


def mixed_date(value: str) -> str:
    """The first of the known date spellings, else null."""
    text = stripped(value)
    return (
        f"CASE WHEN {text} RLIKE r'^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$' THEN try_to_date({text}, 'yyyy-M-d')"
        f" WHEN {text} RLIKE r'^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$' THEN try_to_date({text}, 'd/M/yyyy')"
        f" WHEN {text} RLIKE r'^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$' THEN try_to_date({text}, 'd-M-yyyy')"
        f" WHEN {text} RLIKE r'^\\d{{8}}$' THEN try_to_date({text}, 'ddMMyyyy')"
        f" WHEN {text} RLIKE r'^\\d{{10}}$' THEN date_add(DATE'1970-01-01',"
        f" CAST(floor(CAST({text} AS BIGINT) / 86400) AS INT)) END"
    )


def boolean(value: str) -> str:
    text = f"lower({stripped(value)})"
    return (
        f"CASE WHEN {text} IN ({tokens(BOOLEAN_TRUE)}) THEN true"
        f" WHEN {text} IN ({tokens(BOOLEAN_FALSE)}) THEN false END"
    )


def title_case(value: str) -> str:
    """Upper case after every non-letter, lower case elsewhere.

    ``initcap`` breaks words at spaces only, which is enough (and stays in
    generated code) for text of plain letters and spaces. A letter whose upper
    case has several letters (``ß``) keeps only the first of them in upper case.
    """
    first = "upper(left(w, 1))"
    word = f"concat(left({first}, 1), lower(substr({first}, 2)), lower(substr(w, 2)))"
    pieces = f"array_join(transform(regexp_extract_all({value}, r'(\\p{{L}}+|\\P{{L}}+)', 1), w -> {word}), '')"
    return f"CASE WHEN {value} RLIKE r'[^A-Za-z ]' THEN {pieces} ELSE initcap({value}) END"


def phone(value: str) -> str:
    digits = f"regexp_replace({value}, r'\\D', '')"
    return (
        f"CASE WHEN length({digits}) = 11 AND startswith({digits}, '0') THEN concat('+44', substr({digits}, 2))"
        f" WHEN length({digits}) = 12 AND startswith({digits}, '44') THEN concat('+', {digits})"
        f" ELSE nullif({digits}, '') END"
    )


def canonical(value: str, variants: dict[str, tuple[str, ...]], default: str) -> str:
    """Spelling variants (compared in lower case) to their canonical value."""
    text = f"lower({stripped(value)})"
    whens = " ".join(
        f"WHEN {text} IN ({tokens(sorted({s.lower() for s in spellings}))}) THEN {literal(name)}"
        for name, spellings in variants.items()
    )
    return f"CASE {whens} ELSE {default} END"


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"


def letter_pattern(value: str, mode: str = "letters") -> str:
    """Shape of a text: letters become ``A``; ``letters_digits`` also turns digits into ``9``."""
    if mode == "letters":
        return f"translate({value}, '{LETTERS}', '{'A' * 52}')"
    if mode == "letters_digits":
        return f"translate({value}, '{LETTERS}{DIGITS}', '{'A' * 52}{'9' * 10}')"
    raise ValueError(f"unknown pattern mode: {mode}")

