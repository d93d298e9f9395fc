"""Problem 8: one form for texts that look alike.

Compatibility normalisation in composed form, mapped blanks and the removal of
default-ignorable characters, applied once per distinct value that a task meets.
Full case folding and the compatibility mappings of raised, circled or styled characters
are left out of ``visible_form``, since those differences can be seen;
``comparison_form`` applies them all.
"""
from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.bpe import WHITE_SPACE
from quarrykit.llm.common import by_bytes
from quarrykit.session import cut_lineage

#: Ranges of the Unicode property Default_Ignorable_Code_Point.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Letters and signs of other scripts and the ASCII sign of the same shape.
SAME_SHAPE = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХҮԌԚԜӀаеорсухѕіјһԁԛԝӏү", "ABESIJKMHOPCTXYGQWIaeopcyxsijhdqwly"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj"),
    "Armenian": ("ՍՕսօհոցզյ", "UOuohngqj"),
    "Latin": ("ɡɑǃ", "ga!"),
    "signs": ("‐․꞉", "-.:"),
    "kana": ("ヘ", "へ"),
}
#: Letters that the public table of confusables lists although they can be told apart from the ASCII letter.
TOLD_APART = "αγικρσυгҽьЬբеժƖ"
LINE_ENDS = (0x0A, 0x0D)
#: Distinct texts whose form one task remembers; beyond it the memory starts anew.
MEMORY = 1 << 18
#: Rows of one spelling that are paired in one task.
PART_ROWS = 20_000


def confusable_letters(spark: SparkSession | None) -> dict[int, str]:
    """Cased letters of other scripts with the skeleton and the case of an ASCII letter.

    Skeletons are those of Unicode's table of confusables, in the ICU library
    that Spark brings along. One call on the driver reads them all. Latin
    letters are left out, since a dot, hook or stroke shows; so are characters
    with a decomposition, which have their own rules. Without a JVM at hand
    there are none.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return {}
    letters = [chr(p) for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) in ("Lu", "Ll") and not unicodedata.decomposition(chr(p))]
    skeletons = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    plain = {(s, unicodedata.category(c)): c for c, s in zip(letters, skeletons) if c.isascii()}
    found = {}
    for letter, skeleton in zip(letters, skeletons):
        same = plain.get((skeleton, unicodedata.category(letter)))
        if same and not letter.isascii() and letter not in TOLD_APART and not unicodedata.name(letter, "LATIN").startswith("LATIN"):
            found[ord(letter)] = same
    return found


def shape_table(spark: SparkSession | None = None) -> dict[int, str]:
    """What each decomposed character becomes; characters that stay are not in it.

    Width variants, no-break variants, ligatures, number letters and radicals
    take their compatibility mapping; line ends stay, every other blank is a
    space. Letters of other scripts become the ASCII letter of the same shape.
    """
    table: dict[int, str] = {}
    same = {ord(a): b for shapes, plain in SAME_SHAPE.values() for a, b in zip(shapes, plain)} | confusable_letters(spark)
    for point in range(0x80, sys.maxunicode + 1):
        tag, _, rest = unicodedata.decomposition(chr(point)).partition(" ")
        if not tag.startswith("<"):
            continue
        plain = unicodedata.normalize("NFKD", chr(point))
        joined = tag == "<compat>" and (len(rest.split()) > 1 and rest.split()[0] != "0020" or 0x2160 <= point < 0x2180 or point == 0xB5 or unicodedata.name(chr(point), "").startswith("KANGXI RADICAL"))
        if tag in ("<wide>", "<narrow>", "<noBreak>") or joined:
            table[point] = "".join(same.get(ord(c), c) for c in plain)
    table.update(same)
    table.update({point: " " for point in WHITE_SPACE if point not in LINE_ENDS})
    table.update({point: "" for first, last in IGNORABLE for point in range(first, last + 1)})
    return table


def visible(text: str, table: dict[int, str]) -> str:
    """The form that two texts share if and only if they show the same."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table))
    elif not text.isprintable():
        text = text.translate(table)
    return text.replace("\r\n", "\n").rstrip()


def comparable(text: str, table: dict[int, str]) -> str:
    """``visible`` with compatibility forms and full case folding on top."""
    text = unicodedata.normalize("NFKC", visible(text, table)).casefold()
    return unicodedata.normalize("NFKC", text)


def _digest(value: bytes) -> bytes:
    return hashlib.blake2b(value, digest_size=16).digest()


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and digests of visible form and text, null for blank forms; once per distinct value that a task remembers."""
    source = df.select(F.col(key), F.col(text).alias("__text"))
    table = shape_table(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes | None] = {}
        for batch in batches:
            own, shown = [], []
            for part in by_bytes(batch, 1):
                for value in part.column(1).cast(pa.large_binary()).to_pylist():
                    name = None if value is None else _digest(value)
                    if name is not None and name not in known:
                        if len(known) >= MEMORY:
                            known.clear()
                        form = visible(value.decode("utf-8", "replace"), table)
                        known[name] = _digest(form.encode("utf-8", "surrogatepass")) if form.strip() else None
                    shown.append(known.get(name))
                    own.append(name if shown[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.binary()), pa.array(own, pa.binary())], names=[key, "form_digest", "text_digest"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, form_digest binary, text_digest binary")


def _with_form(df: DataFrame, key: str, text: str, form) -> DataFrame:
    """key and form; once per distinct value of what is worked on at a time."""
    source = df.select(F.col(key), F.col(text).alias("__text"))
    table = shape_table(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                coded = part.column(1).dictionary_encode()
                made = [form(value.decode("utf-8", "replace"), table) for value in coded.dictionary.cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string()).take(coded.indices)], names=[key, "form"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, form string")


def visible_form(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``form``: equal for texts that show the same; null for a null text."""
    return _with_form(df, key, text, visible)


def comparison_form(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``form`` with case, raised digits and styled letters folded as well."""
    return _with_form(df, key, text, comparable)


def _spellings(shown: DataFrame) -> DataFrame:
    """(form_digest, text_digest, rows) of the forms that have several spellings.

    A form with one spelling leaves after a combined minimum and maximum, so a
    mass of exact copies meets nobody.
    """
    spellings = shown.groupBy("form_digest", "text_digest").agg(F.count(F.lit(1)).alias("rows"))
    several = spellings.groupBy("form_digest").agg(F.min("text_digest").alias("low"), F.max("text_digest").alias("high")).where("low < high").select("form_digest")
    return spellings.join(several, "form_digest", "left_semi")


def look_alike_forms(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row whose text has a look-alike: (``key``, form, spelling, form_rows, form_spellings).

    ``form`` is the least key of all that show the same, ``spelling`` the least
    of those that are equal as well; two rows of one form and different
    spellings are a pair of ``look_alike_pairs``, and none is expanded here.
    Null, empty and blank texts have no row. Texts are normalised once while the
    plan is made.
    """
    shown = cut_lineage(_digests(df, key, text).where("form_digest IS NOT NULL"))
    least = shown.groupBy("form_digest", "text_digest").agg(F.min(key).alias("spelling"), F.count(F.lit(1)).alias("rows"))
    forms = least.groupBy("form_digest").agg(
        F.min("spelling").alias("form"), F.sum("rows").alias("form_rows"), F.count(F.lit(1)).alias("form_spellings")
    ).where("form_spellings > 1")
    named = least.join(forms, "form_digest").select("text_digest", "form", "spelling", "form_rows", "form_spellings")
    return shown.join(named, "text_digest").select(key, "form", "spelling", "form_rows", "form_spellings")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (``key``_a < ``key``_b) of rows whose texts show the same but differ.

    Null, empty and blank texts (also those of invisible characters only) are in
    no pair; exact copies make no pair with each other, but each does with every
    other spelling. Texts are read and normalised once, while the plan is made;
    from then on only 16-byte digests are kept and shuffled. The joins run over
    distinct spellings first and fan out to rows last; a spelling of many rows
    is split into parts of about PART_ROWS, so that no task pairs more. Two
    texts are taken as equal if their 128-bit digests are.
    """
    shown = cut_lineage(_digests(df, key, text).where("form_digest IS NOT NULL"))
    parts = F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts")
    kept = _spellings(shown).select("form_digest", "text_digest", parts)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = kept.select("form_digest", F.col("text_digest").alias("text_a"), every.alias("part_a"))
    b = kept.select("form_digest", F.col("text_digest").alias("text_b"), every.alias("part_b"))
    met = a.join(b, "form_digest").where("text_a < text_b").select("text_a", "part_a", "text_b", "part_b")
    part = F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part")
    rows = shown.join(kept.select("text_digest", "parts"), "text_digest").select("text_digest", part, F.col(key).alias("row"))
    left = rows.select(F.col("text_digest").alias("text_a"), F.col("part").alias("part_a"), F.col("row").alias("x"))
    right = rows.select(F.col("text_digest").alias("text_b"), F.col("part").alias("part_b"), F.col("row").alias("y"))
    pairs = met.join(left, ["text_a", "part_a"]).join(right, ["text_b", "part_b"])
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
