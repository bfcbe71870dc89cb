"""Fill-in-middle: texts cut in three by one match of a pattern with counted possessive quantifiers.

``regexp_count`` gives the number of units (code points) of a text. Its pattern then names the cuts:
``unit{a}`` possessive, ``unit{b-a}`` possessive, the rest. Nothing can backtrack, and every quantifier
repeats a single character, so the match is one loop over the text at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import body

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "(?s:.)"
STRIDE = 1024
PLAIN_FROM = 90  # of 100
SPM_BELOW = 20  # of 100
# Order of the parts in the output; the groups are prefix 1, middle 2, suffix 3.
LAYOUT = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
# The markers in that order, and the parts between them put back.
BACK = {
    "psm": (rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2"),
    "spm": (rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1"),
}


def n_units(text: Column) -> Column:
    """Code points of a text, counted in strides so that memory stays near the text's own size."""
    strides = F.regexp_count(text, F.lit(f"{UNIT}{{{STRIDE}}}"))
    rest = F.regexp_replace(text, rf"\A(?:{UNIT}{{{STRIDE}}})*+", "")
    return (strides * STRIDE + F.regexp_count(rest, F.lit(UNIT))).cast("long")


def draws(id_col: str = "doc_id", seed: int = 1) -> list[Column]:
    """Four integers below 2**32 from the SHA-256 of ``seed:id``; a null id counts as an empty string."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return [F.conv(F.substring(F.sha2(name, 256), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut_pattern(first: Column, second: Column) -> Column:
    """Prefix of ``first`` units, middle up to ``second``, suffix."""
    return F.concat(
        F.lit(rf"\A({UNIT}{{"), first.cast("string"), F.lit(rf"}}+)({UNIT}{{"), (second - first).cast("string"), F.lit(rf"}}+)({UNIT}*+)\z")
    )


def transform(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` with a struct ``fim`` added: ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    Rows of ``doc_id, text`` and any other columns, whatever their names (a column ``fim`` is replaced).
    A null text is empty; an empty text, or one that holds a marker, stays plain. Rows equal in id and text get
    equal cuts; null ids draw as one id. Every text is cut whole, however long; an empty table gives no rows.
    """
    h = draws("row.doc_id", seed)
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", body("row.text").alias("text"))
    counted = rows.select("row", "text", n_units(F.col("text")).alias("n"), *[d.alias(f"h{i + 1}") for i, d in enumerate(h)])
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= plain_from)
    ends = [F.col(c) % (F.col("n") + 1) for c in ("h1", "h2")]
    placed = counted.select(
        "row",
        "text",
        "n",
        F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm").alias("form"),
        F.least(*ends).alias("a"),
        F.greatest(*ends).alias("b"),
    )
    order = F.when(F.col("form") == "spm", LAYOUT["spm"]).otherwise(LAYOUT["psm"])
    cut = F.regexp_replace("text", cut_pattern(F.col("a"), F.col("b")), order)
    shown = F.col("form") != "plain"
    fim = F.struct(
        "n",
        "form",
        F.when(shown, F.col("a")).alias("prefix_chars"),
        F.when(shown, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(shown, cut).otherwise(F.col("text")).alias("output"),
    )
    return placed.select("row", fim.alias("fim")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "fim"], "fim")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    back = F.when(form == "spm", F.regexp_replace(output, *BACK["spm"])).when(form == "psm", F.regexp_replace(output, *BACK["psm"]))
    return back.otherwise(output)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """The digest rows of ``transform`` with the text rebuilt from each output."""
    done = transform(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), r AS (
    SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
           ('0x' || substr(h, 17, 8))::BIGINT % 100 AS z, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS w
    FROM d
), f AS (
    SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 90 THEN 'plain'
                WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM r
), p AS (
    SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
