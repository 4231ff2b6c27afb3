"""Fill-in-middle transformation by counted quantifiers.

A text is cut into units. ``regexp_count`` tells how many there are, two draws from
a hash of the document's id choose where the middle begins and ends, and one match
of a pattern with possessive counted groups moves the three parts to their places.
Nothing but Spark's own functions is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A unit is a run of ASCII letters or any other single character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, how many are transformed, and of those how many with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

_PARTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def _draw(digest: Column, number: int) -> Column:
    """The ``number``-th group of 8 hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    n is the number of units. The prefix ends after the smaller of two numbers of
    units from 0 to n, the middle after the larger; both and the form come from the
    SHA-256 of ``seed``, a colon and the decimal doc_id. The form is ``plain`` (output
    is the text), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle);
    prefix_chars and middle_chars count code points and are null for plain texts.

    * null and empty texts: n 0, plain, output empty
    * texts that hold a marker: plain, so that every output can be undone
    * texts of any length: one match whose groups never back up, so no recursion
    * null doc_id: drawn as if the id were the empty text; repeated rows: equal outputs
    * columns of ``docs`` named like an added one are replaced; an empty table stays empty
    """
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in _PARTS]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("_row"), text.alias("_text"), digest.alias("_digest"),
                       F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"))
    first, second = (F.pmod(_draw(F.col("_digest"), k), F.col("n") + 1) for k in (1, 2))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_text", F.lit(marker))
    plain = (F.col("n") == 0) | marked | (_draw(F.col("_digest"), 3) % 100 >= transformed)
    rows = rows.select("_row", "_text", "n", F.least(first, second).alias("_from"), F.greatest(first, second).alias("_to"),
                       F.when(plain, "plain").when(_draw(F.col("_digest"), 4) % 100 < suffix_first, "spm").otherwise("psm").alias("form"))
    # Units never give back letters, and counted groups never give back units: the match is one pass without recursion.
    unit = F.lit("((?:[A-Za-z]++|[^A-Za-z]){")
    pattern = F.concat(F.lit(r"\A"), unit, F.col("_from").cast("string"), F.lit("}+)"), unit,
                       (F.col("_to") - F.col("_from")).cast("string"), F.lit(r"}+)((?s:.*+))\z"))
    order = (F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
             .otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(
        F.regexp_replace("_text", pattern, order)))
    # A marker starts with the only "<" in it and stands nowhere in the text, so its first place is its own.
    at = {m: F.position(F.lit(m), F.col("output")) for m in (PREFIX, SUFFIX, MIDDLE)}
    size = F.char_length("output")
    prefix = F.when(F.col("form") == "psm", at[SUFFIX] - 1 - len(PREFIX)).when(
        F.col("form") == "spm", at[MIDDLE] - at[PREFIX] - len(PREFIX))
    middle = F.when(F.col("form") != "plain", size - at[MIDDLE] + 1 - len(MIDDLE))
    return rows.select("_row.*", "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of, from output and form alone; null where one is null."""
    parts = {"psm": rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "spm": rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z"}
    return (F.when(F.col(form) == "plain", F.col(output))
            .when(F.col(form) == "psm", F.regexp_replace(output, parts["psm"], "$1$3$2"))
            .when(F.col(form) == "spm", F.regexp_replace(output, parts["spm"], "$2$3$1")))
