"""Line-first quality rules: judge each line, drop failures, then reject documents that lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import SPACE_RUN, let, words_of

SYMBOLS = "#*$%&|<>"
#: A line ends with one of these, in quotation marks or brackets perhaps, or it isn't prose.
SENTENCE_END = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*\z"
#: What makes noise: symbols, and marks of surprise or question in a row.
NOISE = r"[#*$%&|<>]|[!?]{2,}"
#: Marks between the entries of a menu.
MENU_MARK = r"[|»›→•·]"
#: Phrases of page furniture in English, German, French and Spanish, behind the start or something other than a letter.
BOILERPLATE = (
    r"(?i)(?:^|[^a-z])(?:enable javascript|javascript is (?:disabled|required)|accept (?:all )?cookies|we use cookies|cookie policy"
    r"|privacy policy|terms of (?:use|service)|click here to|sign up (?:now|for)|subscribe to our|log ?in to your"
    r"|share this (?:page|article)|back to top|lorem ipsum"
    r"|javascript aktivieren|(?:alle )?cookies akzeptieren|wir verwenden cookies|datenschutzerkl|allgemeine nutzungsbedingungen|hier klicken, um|jetzt anmelden|newsletter abonnieren|seite teilen|zum seitenanfang"
    r"|activer javascript|accepter (?:tous )?les cookies|nous utilisons des cookies|politique de confidentialit|conditions d'utilisation|cliquez ici pour|inscrivez-vous|abonnez-vous|partager cette page|haut de (?:la )?page"
    r"|activar javascript|aceptar (?:todas )?las cookies|utilizamos cookies|aviso de privacidad|condiciones de uso|haga clic aqu|reg.strese ahora|suscr.base|compartir esta p.gina|volver arriba)"
)
#: A character that isn't white space.
INK = r"[^\x20\x09-\x0D]"
WINDOW = 5


def _count(text: Column, others: str) -> Column:
    """The characters of a text that are left without what the pattern finds."""
    return F.char_length(F.regexp_replace(text, others, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more, the first occurrence included."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]),
        )
        return let(windows, of_windows)

    def of_windows(v: Column) -> Column:
        placed = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(let(placed, covered))

    def covered(s: Column) -> Column:
        again = F.filter(
            s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(F.transform(again, lambda x: x["i"])),
            start,
            lambda a, p: F.struct(
                (a["n"] + (p + WINDOW - F.greatest(p, a["end"]))).cast("long").alias("n"), (p + WINDOW).cast("int").alias("end")
            ),
            lambda a: a["n"],
        )

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes)
    )


def _line_passes(line: Column, max_symbol_share: float, menu_words: int) -> Column:
    """Punctuation, navigation and boilerplate rules for one line that has a word. Words are counted only where there are marks."""
    length, n_words = F.char_length(line), F.size(words_of(line))
    quiet = let(length - _count(line, NOISE), lambda noise: F.when(noise == 0, F.lit(True)).otherwise(noise <= max_symbol_share * n_words))
    menu = let(length - _count(line, MENU_MARK), lambda marks: F.when(marks < 2, F.lit(False)).otherwise(n_words <= menu_words * marks))
    return line.rlike(SENTENCE_END) & quiet & ~menu & ~line.rlike(BOILERPLATE)


#: What findings() gives.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean", "n_lines", "n_bad_lines", "lost")


def findings(text: Column, max_loss: float = 0.5, max_symbol_share: float = 0.3, menu_words: int = 3, min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    """All that the rules find in a text, as one struct with the fields NAMES."""
    raw = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(INK))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        def of_good(good: Column) -> Column:
            return F.struct(
                F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), F.size(good).cast("long").alias("n_good"), F.array_join(good, "\n").alias("clean")
            )

        return let(F.filter(ls, lambda x: _line_passes(x, max_symbol_share, menu_words)), of_good)

    def verdict(f: Column) -> Column:
        failed = (f["w"]["n_words"] < min_words) | (100 * f["w"]["n_repeat_words"] > max_repeat_percent * f["w"]["n_words"])
        good_chars = F.when(f["l"]["n_good"] == f["l"]["n_lines"], f["word_chars"]).otherwise(_count(f["l"]["clean"], SPACE_RUN))
        lost = F.when(f["word_chars"] > 0, 1 - good_chars / f["word_chars"]).otherwise(1.0)

        def found(lost: Column) -> Column:
            named = {
                "n_words": f["w"]["n_words"], "word_chars": f["word_chars"], "n_symbols": f["n_symbols"], "n_dup_lines": f["l"]["n_dup_lines"], "n_repeat_words": f["w"]["n_repeat_words"],
                "base_failed": failed, "kept": ~failed & (lost <= max_loss), "clean": f["l"]["clean"], "n_lines": f["l"]["n_lines"], "n_bad_lines": f["l"]["n_lines"] - f["l"]["n_good"], "lost": lost,
            }
            return F.struct(*[named[n].alias(n) for n in NAMES])

        return let(lost, found)

    first = F.struct(
        _count(raw, SPACE_RUN).cast("long").alias("word_chars"),
        _count(raw, f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
        let(words_of(raw), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
    )
    return let(first, verdict)


def judge(docs: DataFrame, text: str = "text", prefix: str = "_q_", **rules) -> DataFrame:
    """All of docs' columns and rows, plus the rules' findings under ``prefix``.

    prefix + n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    clean (the text's lines that have a word and pass), n_lines, n_bad_lines, lost (share of the word characters on
    failing lines). rules: see findings().

    Null texts count as empty: no words, so base_failed and not kept. Empty and blank texts the same. Repeated
    rows are judged alike, an empty table gives none, and columns whose names clash with the results can be
    avoided by another prefix (a clash is an error, never silent). Texts of any length are judged whole; one text
    has to fit a task.
    """
    if clash := {prefix + n for n in NAMES} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")
    at = prefix + "found"
    return docs.withColumn(at, findings(docs[f"`{text}`"], **rules)).withColumns({prefix + n: F.col(f"`{at}`.{n}") for n in NAMES}).drop(at)


def clean(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The documents that pass, with docs' own columns; texts without the lines that fail.

    Texts that lose no line stay as they are, blank lines included. One generator both judges and drops: a filter over
    the findings would be pushed below them, and the rules would run twice.
    """
    at = "_q_found"
    while at in docs.columns:
        at = "_" + at
    passed = F.explode(F.filter(F.array(findings(docs[f"`{text}`"], **rules)), lambda f: f["kept"]))
    judged = docs.select("*", passed.alias(at))
    new = F.when(F.col(f"`{at}`.n_bad_lines") == 0, F.col(f"`{text}`")).otherwise(F.col(f"`{at}`.clean"))
    return judged.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = judge(docs)
    return q.select(
        "doc_id",
        *[F.col("_q_" + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines")],
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, ls, list_filter(ls, lambda x:
        regexp_matches(x, '[.!?\x{2026}:;\x{3002}\x{FF01}\x{FF1F}]["''\x{201D}\x{2019}\x{00BB})\]]*[\x20\x09-\x0D]*\z')
        AND length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) + length(x) - length(regexp_replace(x, '[!?]{2,}', '', 'g'))
            <= 0.3::DOUBLE * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
        AND NOT (length(regexp_replace(x, '[^|\x{00BB}\x{203A}\x{2192}\x{2022}\x{00B7}]', '', 'g')) >= 2
                 AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 3 * length(regexp_replace(x, '[^|\x{00BB}\x{203A}\x{2192}\x{2022}\x{00B7}]', '', 'g')))
        AND NOT regexp_matches(x, '@BOILERPLATE@')) AS good
      FROM l),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
        length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(good))::BIGINT AS n_bad_lines,
        length(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]', '', 'g')) AS good_chars
      FROM w JOIN g USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND word_chars > 0 AND 1 - good_chars::DOUBLE / word_chars <= 0.5::DOUBLE AS kept,
  n_lines, n_bad_lines
FROM m
""".replace("@BOILERPLATE@", BOILERPLATE.replace("'", "''"))
