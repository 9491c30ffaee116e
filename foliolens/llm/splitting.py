"""Problem 5: cut sections that are too long at natural boundaries, with overlap.

One regular expression with bounded quantifiers consumes the section: its
alternatives, strongest boundary first, take as many words as the limit allows up
to a paragraph's end, a sentence's end, a line's end, else up to any word. A word is
consumed in runs of at most RUN characters, of scripts without blanks SHORT_RUN, so that
a text without blanks is cut between characters in the end. Offsets into the array of
runs then look back for the overlap. Everything is a built-in expression on arrays;
nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.session import table

LIMIT, OVERLAP = 250, 30
WORD = r"(?U)\S+"
#: Most characters of a word that count as one, and of a word of a script without blanks.
RUN, SHORT_RUN = 32, 4
# The ranges of scripts without blanks (Thai, Lao, Burmese, Khmer, Kana, Han).
DENSE = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
UNIT = rf"(?:[^\s{DENSE}]{{1,{RUN}}}+|[{DENSE}]{{1,{SHORT_RUN}}}+)"


def pattern(fresh: int) -> str:
    """The pieces of at most `fresh` runs; boundaries count in the second half of a piece only."""
    lead = rf"(?:{UNIT}\s*+){{{fresh // 2},{fresh - 1}}}"
    return (
        r"(?U)"
        rf"{lead}{UNIT}(?=[^\S\n]*\n[^\S\n]*\n|\s*\z)"  # a paragraph's end
        rf"|{lead}{UNIT}(?<=[.!?…。！？؟।][\"'”’»)\]」』）]{{0,3}})(?=[\s{DENSE}])"  # a sentence's end
        rf"|{lead}{UNIT}(?=[^\S\n]*\n)"  # a line's end
        rf"|{lead}{UNIT}(?=\s)"  # a word's end
        rf"|(?:{UNIT}\s*+){{0,{fresh - 1}}}{UNIT}"  # any run of characters
    )


def chunk_texts(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (paper_id, chunk_id, start_line, last_line, words array<struct<w, line>>, body).

    A chunk goes from start_line to the line before the paper's next start_line, or to the
    text's end; end_line and the stored word counts are not trusted. Copies of a row count
    once. Chunks without start_line, of papers without text, or that start after the
    text's end have no words and are left out; chunks of one paper that start at the same
    line have the same lines.
    """
    c = chunks.select("paper_id", "chunk_id", "start_line").where("start_line is not null and start_line >= 1").distinct()
    starts = c.select("paper_id", "start_line").distinct()
    nxt = F.lead("start_line").over(Window.partitionBy("paper_id").orderBy("start_line"))
    starts = starts.withColumn("next_line", nxt)
    t = texts.select("paper_id", F.col("extracted_text").alias("text")).where("text <> ''").distinct()
    lines = F.split("text", "\n")
    upto = F.coalesce(F.col("next_line") - 1, F.size("lines"))
    return (
        c.join(starts, ["paper_id", "start_line"])
        .join(t.select("paper_id", lines.alias("lines")), "paper_id")
        .where(F.col("start_line") <= F.size("lines"))
        .withColumn("last_line", F.least(upto, F.size("lines")))
        .withColumn("part", F.slice("lines", F.col("start_line"), F.greatest(F.lit(0), F.col("last_line") - F.col("start_line") + 1)))
        .withColumn("body", F.array_join("part", "\n"))
        .withColumn(
            "words",
            F.flatten(
                F.transform(
                    "part",
                    lambda line, i: F.transform(
                        F.regexp_extract_all(line, F.lit("(?U)" + UNIT), F.lit(0)),
                        lambda w: F.struct(w.alias("w"), (i + F.col("start_line")).alias("line")),
                    ),
                )
            ),
        )
        .select("paper_id", "chunk_id", "start_line", "last_line", "words", "body")
    )


def pieces(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the sections longer than limit words, or as many runs of characters, in order.

    Rows (paper_id, chunk_id, piece, n_words, start_line, end_line, text, section_words): each piece has at
    most limit words, the first `overlap` of which, from the second piece on, are the last
    of the piece before; a word longer than RUN characters counts as several, as does one of a script without
    blanks longer than SHORT_RUN. text keeps the words with single blanks, line breaks go.
    """
    cuts = F.regexp_extract_all("body", F.lit(pattern(limit - overlap)), F.lit(0))
    sizes = F.transform(cuts, lambda p: F.size(F.regexp_extract_all(p, F.lit("(?U)" + UNIT), F.lit(0))))
    ends = F.expr("transform(sizes, (x, i) -> aggregate(slice(sizes, 1, i + 1), 0, (a, b) -> a + b))")
    piece = F.expr(
        f"transform(ends, (e, i) -> named_struct('piece', i + 1, 'words', "
        f"slice(words, greatest(1, e - sizes[i] + 1 - if(i = 0, 0, {overlap})), "
        f"e - greatest(1, e - sizes[i] + 1 - if(i = 0, 0, {overlap})) + 1)))"
    )
    return (
        sections.where(F.size("words") > limit)
        .withColumn("sizes", sizes)
        .withColumn("ends", ends)
        .withColumn("p", F.explode(piece))
        .select(
            "paper_id",
            "chunk_id",
            F.col("p.piece").alias("piece"),
            F.size("p.words").alias("n_words"),
            F.element_at("p.words.line", 1).alias("start_line"),
            F.element_at("p.words.line", -1).alias("end_line"),
            F.array_join("p.words.w", " ").alias("text"),
            F.size(F.regexp_extract_all("body", F.lit(WORD), F.lit(0))).alias("section_words"),
        )
    )


def p5_pieces(spark, sf_dir) -> DataFrame:
    """The pieces of every chunk longer than 250 words; see pieces()."""
    return pieces(chunk_texts(table(spark, sf_dir, "chunk_map"), table(spark, sf_dir, "original_converted")))


def p5_found(spark, sf_dir) -> DataFrame:
    """Rows (paper_id, chunk_id) of the chunks of more than 250 words that the operator splits."""
    return p5_pieces(spark, sf_dir).where(F.col("section_words") > LIMIT).select("paper_id", "chunk_id").distinct()


P5_FOUND_SQL = r"""
WITH c AS (SELECT DISTINCT paper_id, chunk_id, start_line FROM chunk_map WHERE start_line >= 1),
n AS (SELECT paper_id, start_line, lead(start_line) OVER (PARTITION BY paper_id ORDER BY start_line) AS next_line
      FROM (SELECT DISTINCT paper_id, start_line FROM c)),
t AS (SELECT DISTINCT paper_id, string_split(extracted_text, chr(10)) AS lines FROM original_converted WHERE extracted_text <> ''),
x AS (SELECT c.paper_id, c.chunk_id,
             array_to_string(lines[c.start_line : coalesce(next_line - 1, len(lines))], chr(10)) AS body
      FROM c JOIN n USING (paper_id, start_line) JOIN t USING (paper_id))
SELECT DISTINCT paper_id, chunk_id FROM x WHERE len(regexp_extract_all(body, '[^\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{2028}\x{2029}\x{85}\x{0B}]+')) > 250
"""
