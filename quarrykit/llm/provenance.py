"""Problem 3: files that nobody on the team wrote by hand.

Each file is a small Merkle tree: its leaves are hashes of three consecutive
lines of code, its digest is that of all of them. Digests are combined bottom-up
over the directory trees. Subtrees that unrelated workspaces share, from a
single file to a whole tree, mark copied code; where a copy was touched
afterwards, long runs of its leaves still do. Header, path and layout rules
catch emitted, squeezed and bulk-data files.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import SpanHash, mix
from quarrykit.session import cut_lineage

#: Lines of one leaf, and the share of a file's leaves that must be found elsewhere.
LEAF_LINES = 3
SHARED = 0.35
#: Neighbouring leaves that must be found elsewhere together, or that a shared subtree has at least: six lines of
#: code. Fewer are an idiom that anybody may write. How often a leaf occurs is no measure, as a copy may be everywhere.
RUN_LEAVES = 4
CHUNK_BYTES = 1 << 19

#: What a statement in a comment starts after: the margin and comment signs, or the end of the statement before.
START = rb"(?:^[\s/*!#<>-]*|[.!:;,]\s+|\s-+\s+)(?:(?:note|notice|warning|attention|achtung|hinweis|caution|important)[:!]?\s+)?"
#: What such a statement may be about: the file itself.
SUBJECT = rb"(?:(?:this|the|diese[rs]?|ce|este|esta|cet)\s+)?(?:(?:source\s+)?(?:file|code|class|module|source|stub|client|interface|program)s?|datei|klasse|fichier|fichero|archivo|arquivo|c[o\xc3\xb3]+digo|code)"
#: What generators write into the comments at the head or end of a file.
GENERATED_HEAD = re.compile(
    rb"(?i)(?<![\w.])@generated\b|<auto-?generated|"
    + START
    + rb"(?:"
    + rb"(?:" + SUBJECT + rb"\s+(?:(?:is|was|were|are|has been|wurde|wird|ist|a [e\xc3\xa9]+t[e\xc3\xa9]+|est|fue|foi)\s+)?)?(?:(?:an?|the)\s+)?(?:auto(?:matically|matisch|m[a\xc3\xa1]+ticamente|matiquement)?[-_ ]?)?"
    + rb"(?:generated(?=\s+(?:by|from|with|using|on|at|file|code|class|source|do\s+not)\b|\s*[.:*!]|\s*$)|(?:generiert|erzeugt)\b|g[e\xc3\xa9]+n[e\xc3\xa9]+r[e\xc3\xa9]+\s+(?:par|automatiquement)|generado\s+(?:por|autom)|gerado\s+(?:por|autom)"
    + rb"|(?:produced|emitted|created|written)\s+by\s+(?:the\s+)?[\w.-]+(?:\s+(?:compiler|generator)|,?\s+edit)\b)"
    + rb"|(?:will\s+be\s+|gets\s+)?overwritten\s+(?:on|by|at)\s+(?:every|each|the\s+next)|(?:all\s+|any\s+|your\s+)?(?:manual\s+)?changes\s+(?:to\s+this\s+file\s+)?will\s+be\s+(?:lost|overwritten)"
    + rb"|(?:please\s+)?(?:do\s+not|don't)\s+(?:edit|modify|change)\s+(?:this\s+file|by\s+hand|manually)|nicht\s+von\s+hand\s+(?:bearbeiten|[a\xc3\xa4]+ndern)|ne\s+pas\s+(?:modifier|[e\xc3\xa9]+diter)|no\s+(?:editar|modificar)\b"
    + rb"|edit\s+\S+\.(?:proto|yaml|yml|g4|xsd|json|idl|thrift|graphql)\s+instead"
    + rb")|(?-i:\bDO NOT (?:EDIT|MODIFY)\b)",
    re.M,
)
GENERATED_ANNOTATION = re.compile(rb"^[ \t\r\f\v]*@(?:javax\.annotation\.|jakarta\.annotation\.)?(?:processing\.)?Generated\s*\(", re.M)
#: What copied libraries carry at their head. Where a copy is said to come from counts with a version, an address or a word for its being whole.
VENDORED_HEAD = re.compile(
    rb"(?i)"
    + START
    + rb"(?:@license\b|@?[\w./-]+\s+v?\d+\.\d+\.\d+\s*(?:\*/|\||$)"
    + rb"|(?:imported|copied|vendored|taken|adapted|forked|ported)\s+(?:(?:unchanged|verbatim|unmodified|as\s+is)\s+from\s+\S|from\s+(?:https?:|git|[\w./@-]+[@\s]v?\d+\.\d+))"
    + rb"|(?:see|refer\s+to)\s+(?:the\s+)?licen[cs]e\s+in\s+the\s+[\w.-]+\s+(?:distribution|package|repository)|\(c\)\s+(?:\d{4}[\d, -]*\s+)?(?:the\s+)?[\w.-]+\s+contributors)|/\*!\s*@?[\w./-]+\s+v?\d+\.\d+",
    re.M,
)
#: Places that only tools or copies fill. A plain package name such as ``vendor``, ``external`` or ``gen`` is not one.
GENERATED_PATH = re.compile(r"/(?:generated-sources|generated/sources|__generated__|src-gen|src/gen/(?:java|ts|js)|app/generated|build/generated)/|(?:\.(?:g|gen|generated|pb)|_pb2?|_grpc)\.[A-Za-z]{2,4}$")
VENDORED_PATH = re.compile(r"^/?[^/]+/[^/]+/(?:vendor|thirdparty|lib/external|src/vendored|public/js/libs)/[^/]+/|(?:^|/)(?:node_modules|bower_components|third_party)/[^/]+/")
MINIFIED_PATH = re.compile(r"[.-]min\.(?:js|css|mjs|cjs)$")

HEAD = re.compile(rb"\A(?:\xef\xbb\xbf)?\s*(?:(?:/\*.*?\*/|//[^\n]*|#[^\n]*)\s*)*", re.S)
STRINGS = re.compile(rb"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
ACCESSOR = re.compile(
    rb"^\s*(?:public\s+)?(?:static\s+)?(?:get|set)\s+\w+\([^)]*\)\s*\{[^{}]*\}\s*$"
    rb"|^\s*public\s[^(){};=]+\([^()]*\)\s*\{\s*(?:return\s+)?[\w.\[\]]+(?:\s*=\s*\w+)?;\s*(?:return this;\s*)?\}\s*$"
    rb"|^\s*private\s+[\w<>\[\]]+\s+\w+_;\s*$"
)
IDENTIFIER = re.compile(rb"[A-Za-z_$][\w$]*")
DATA = re.compile(rb"\(byte\)|0x[0-9A-Fa-f]+|[-+]?\d[\d_.]*(?:[eE][-+]?\d+)?[fFdDlL]?")
LONG_LINE = 200
#: Bytes up to which a table of data is a short one, as anybody has in code.
SHORT_TABLE = 400
#: What a line without code consists of.
BRACKETS = b"{}()[];, \t"


def layout(text: bytes) -> str | None:
    """``generated``, ``minified`` or ``data`` if the layout of the code says so.

    Generated: most lines are one-line accessors or their fields. Minified: most
    code stands in long lines without blanks or with one-letter names, string
    contents not counted. Data: most of the text is in lines that hold next to
    nothing but literals and numbers.
    """
    code = text[HEAD.match(text).end() :]
    lines = [x for x in code.split(b"\n") if x.strip()]
    if not lines:
        return None
    if sum(1 for x in lines if ACCESSOR.match(x)) * 2 > len(lines):
        return "generated"
    bare = STRINGS.sub(b'""', code)
    size = max(1, len(bare))
    long = sum(len(x) for x in bare.split(b"\n") if len(x) > LONG_LINE)
    if 2 * long > size:
        names = IDENTIFIER.findall(bare)
        blanks = sum(bare.count(c) for c in (b" ", b"\t", b"\n", b"\r"))
        if blanks < 0.12 * size or sum(len(x) <= 2 for x in names) > 0.4 * max(1, len(names)):
            if sum(map(len, names)) > 0.2 * size:
                return "minified"
    if len(code) >= SHORT_TABLE:
        held = 0
        for line in lines:
            rest = IDENTIFIER.findall(DATA.sub(b"", STRINGS.sub(b"", line)))
            if sum(map(len, rest)) <= 0.15 * len(line.strip()) and len(line.strip()) >= 12 and (STRINGS.search(line) or DATA.search(line)):
                held += len(line)
        if held > 0.6 * len(code) and len(re.findall(rb"[0-9]", code)) > 0.08 * len(code):
            return "data"
    return None


def end_comments(text: bytes) -> bytes:
    """The comments that a file ends with, at the margin: what is indented or stands before a bracket is about the code."""
    stop = at = len(text.rstrip())
    while at:
        line = text.rfind(b"\n", 0, at) + 1
        body = text[line:at]
        if body.startswith((b"//", b"#")):
            first = line
        elif body.endswith(b"*/"):
            first = text.rfind(b"/*", 0, at)
            if first < 0 or text[max(0, first - 1) : first] not in (b"", b"\n"):
                break
        else:
            break
        stop = at = first
        while text[at - 1 : at].isspace():
            at -= 1
    return text[stop:]


def sign(path: str, text: bytes | None) -> str | None:
    """The reason why one file by itself is not hand-written, if it shows one."""
    return signs(path, text)[0]


def signs(path: str, text: bytes | None) -> tuple[str | None, str | None]:
    """``sign`` and what showed it: ``head``, ``layout`` or ``path``."""
    if text:
        head = HEAD.match(text).group()
        if GENERATED_HEAD.search(head) or GENERATED_HEAD.search(end_comments(text)) or (b"Generated" in text and GENERATED_ANNOTATION.search(text)):
            return "generated", "head"
        if found := layout(text):
            return found, "layout"
        if VENDORED_HEAD.search(head):
            return "vendored", "head"
    for found, place in (("generated", GENERATED_PATH), ("vendored", VENDORED_PATH), ("minified", MINIFIED_PATH)):
        if place.search(path):
            return found, "path"
    return None, None


def leaf_lines(text: bytes) -> list[bytes]:
    """The lines that leaves are built from: no blanks at their ends, no comments, no lone brackets."""
    lines = [x.strip() for x in text.split(b"\n")]
    return [x for x in lines if x.strip(BRACKETS) and not x.startswith((b"//", b"/*", b"*", b"#"))]


def leaves(texts: list[list[bytes]], hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """The leaf hashes of each file in the order of its lines, and how many each has.

    A file of fewer lines than a leaf has one leaf of what there is.
    """
    padded = [t + [b""] * (LEAF_LINES - len(t)) if t else [] for t in texts]
    number = np.array([len(t) for t in padded], np.int64)
    size = np.array([len(x) for t in padded for x in t], np.int64)
    if not len(size):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(b"".join(x for t in padded for x in t), np.uint8)
    stop = np.cumsum(size)
    line = hasher(data, stop - size, stop)
    owner = np.repeat(np.arange(len(texts)), number)
    n = len(line) - LEAF_LINES + 1
    leaf = np.zeros(n, np.uint64)
    for i in range(LEAF_LINES):
        leaf = mix(leaf * np.uint64(0x9E3779B97F4A7C15) + line[i : n + i])
    whole = owner[:n] == owner[LEAF_LINES - 1 :]
    return leaf[whole], np.bincount(owner[:n][whole], minlength=len(texts))


def file_trees(files: DataFrame) -> DataFrame:
    """(pos, workspace, file_path, sign, shown, digest, leaves) of each row of scanned files.

    ``digest`` is 16 bytes over the leaves in their order, null for a file
    without a line of code. Comments, blanks and line ends are not in it.
    """
    source = files.select("pos", F.coalesce("workspace", F.lit("")).alias("workspace"), F.coalesce("file_path", F.lit("")).alias("file_path"), "content")

    def build(part: list[tuple], hasher: SpanHash) -> pa.RecordBatch:
        pos, workspace, path, text = zip(*part)
        leaf, count = leaves([leaf_lines(t) if t else [] for t in text], hasher)
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        digest = [hashlib.blake2b(leaf[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        found, shown = zip(*[signs(p, t) for p, t in zip(path, text)])
        columns = {
            "pos": pa.array(pos, pa.int64()),
            "workspace": pa.array(workspace, pa.string()),
            "file_path": pa.array(path, pa.string()),
            "sign": pa.array(found, pa.string()),
            "shown": pa.array(shown, pa.string()),
            "digest": pa.array(digest, pa.binary()),
            "leaves": pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaf.view(np.int64))),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)] + [batch.column(3).cast(pa.large_binary()).to_pylist()]
            part, size = [], 0
            for row in zip(*columns):
                part.append(row)
                size += len(row[3] or b"")
                if size >= CHUNK_BYTES:
                    yield build(part, hasher)
                    part, size = [], 0
            if part:
                yield build(part, hasher)

    return source.mapInArrow(run, "pos bigint, workspace string, file_path string, sign string, shown string, digest binary, leaves array<bigint>")


def _longest_run(places: Column) -> Column:
    """Length of the longest run of consecutive numbers in a sorted array of distinct ones."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, place: Column) -> Column:
        run = F.when(place == state["last"] + 1, state["run"] + 1).otherwise(1)
        return F.struct(place.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(places, start, step, lambda state: state["best"])


def shared_leaves(trees: DataFrame) -> DataFrame:
    """(pos, found, run): how many of a file's leaves another workspace has as well, and how many of them in a row.

    The least and greatest workspace of a leaf are combined before the shuffle,
    so a leaf that a third of all files carry arrives as a few rows.
    """
    rows = trees.select("pos", "workspace", F.posexplode("leaves").alias("place", "leaf"))
    both = rows.groupBy("leaf").agg(F.min("workspace").alias("low"), F.max("workspace").alias("high")).where("low < high").select("leaf")
    places = rows.select("pos", "place", "leaf").join(both, "leaf", "left_semi").groupBy("pos").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return places.select("pos", F.size("places").alias("found"), _longest_run(F.col("places")).alias("run"))


def _between_workspaces(nodes: DataFrame, *digest: str) -> DataFrame:
    """The digests that two workspaces have at least, of nodes that are no idiom."""
    ends = nodes.where(F.col("n_leaves") >= RUN_LEAVES).groupBy(*digest).agg(F.min("workspace").alias("low"), F.max("workspace").alias("high"))
    return ends.where("low < high").select(*digest)


def _ancestors(path: str) -> Column:
    """The directories above a path, from the deepest up, without the first part, which all paths share."""
    return F.expr(f"transform(sequence(2, greatest(size(split({path}, '/')) - 1, 2)), n -> substring_index({path}, '/', n))")


def shared_subtrees(trees: DataFrame) -> DataFrame:
    """(workspace, directory) of the greatest subtrees that another workspace has with equal digest.

    A file's digest goes up to all directories above it at once, each time keyed
    by its path from there; a directory's digest combines those of all files
    below it, so one pass closes every level and no directory is gathered in one
    place, however large or deep. A directory of one file counts as any other.
    Files without a line of code are part of their directories' digests by name
    alone. Directories inside a shared one are left out.
    """
    once = trees.groupBy("workspace", "file_path", "digest").agg(F.max(F.size("leaves")).alias("n_leaves"))
    up = once.select("workspace", "file_path", "digest", "n_leaves", F.explode(_ancestors("file_path")).alias("directory"))
    inside = F.expr("substring(file_path, length(directory) + 2)")
    nodes = up.groupBy("workspace", "directory").agg(
        F.bit_xor(F.xxhash64(inside, "digest")).alias("d1"),
        F.bit_xor(F.xxhash64("digest", inside, F.lit(1))).alias("d2"),
        F.count(F.lit(1)).alias("files"),
        F.sum("n_leaves").alias("n_leaves"),
    )
    digest = ["d1", "d2", "files"]
    shared = nodes.join(_between_workspaces(nodes, *digest), digest, "left_semi").select("workspace", "directory")
    above = shared.select("workspace", F.col("directory").alias("up"))
    return shared.withColumn("up", F.regexp_replace("directory", "/[^/]*$", "")).join(above, ["workspace", "up"], "left_anti").select("workspace", "directory")


def shared_files(trees: DataFrame) -> DataFrame:
    """(pos) of the files that another workspace has with equal digest, under whatever name."""
    nodes = trees.where("digest IS NOT NULL").select("pos", "workspace", "digest", F.size("leaves").alias("n_leaves"))
    return nodes.join(_between_workspaces(nodes, "digest"), "digest", "left_semi").select("pos")


def file_origins(files: DataFrame, shared: float = SHARED) -> DataFrame:
    """(pos, origin, via, share) of every row: where the file came from, what showed it, and its share of leaves found elsewhere.

    ``origin`` is ``generated``, ``minified``, ``data``, ``vendored`` or
    ``hand``. A file's own signs come first; else it is vendored if it is or
    lies in a subtree that another workspace has as well (``via`` is
    ``subtree``), or if at least ``shared`` of its leaves, RUN_LEAVES of them in
    a row, stand in another workspace (``leaves``). ``via`` is ``head``,
    ``layout`` or ``path`` for other signs, null for hand-written files; a
    vendored file that shows a sign and is shared as well is told by the latter.

    A row with a null content is judged by its path; a null path or workspace
    counts as empty. Repeated scans are judged each, and never make a file its
    own copy. An empty table gives none. The trees are written once while the
    plan is made.
    """
    trees = cut_lineage(file_trees(files))
    placed = trees.select("pos", "workspace", F.explode(_ancestors("file_path")).alias("directory"))
    below = placed.join(shared_subtrees(trees), ["workspace", "directory"], "left_semi").select("pos")
    copied = below.unionByName(shared_files(trees)).distinct().withColumn("subtree", F.lit(True))
    share = F.coalesce(F.col("found") / F.nullif(F.size("leaves"), F.lit(0)), F.lit(0.0))
    judged = trees.join(shared_leaves(trees), "pos", "left").join(copied, "pos", "left").withColumn("share", share)
    by_tree = F.when(F.col("subtree"), "subtree").when((F.col("share") >= shared) & (F.col("run") >= RUN_LEAVES), "leaves")
    own = F.col("sign").isNotNull() & (F.col("sign") != "vendored")
    origin = F.when(own, F.col("sign")).when(by_tree.isNotNull(), "vendored").otherwise(F.coalesce("sign", F.lit("hand")))
    return judged.select("pos", origin.alias("origin"), F.when(own, F.col("shown")).otherwise(F.coalesce(by_tree, "shown")).alias("via"), "share")


def not_hand_written(files: DataFrame) -> DataFrame:
    """(pos) of the rows of scanned files that came about otherwise than by hand."""
    return file_origins(files).where("origin != 'hand'").select(F.col("pos").cast("int").alias("pos"))
