"""Problem 5: literal credentials in source and configuration text, and their redaction.

A text is parsed into key paths with byte offsets, whatever format it is in:
maps, calls, nested and indented settings, sections, elements, attributes, and
what stands in its literals and comments, such as escaped JSON, connection
strings and placeholders with defaults. A value counts if the last name of its
path, or the name above a ``value`` or ``default``, is a sensitive one and its
shape is not that of a stand-in, reference or phrase, or if its shape alone
gives it away. Redaction splices a mask over the value's bytes only.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import by_bytes

#: Token shapes that services give out.
SHAPES = re.compile(
    rb"""(?<![A-Za-z0-9_-])(?:
      (?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])
    | gh[pousr]_[A-Za-z0-9]{36,} | github_pat_[A-Za-z0-9_]{40,}
    | glpat-[A-Za-z0-9_-]{20,}
    | xox[abeoprs]-[A-Za-z0-9-]{10,}
    | [srp]k_(?:live|test)_[A-Za-z0-9]{16,} | whsec_[A-Za-z0-9+/=]{24,}
    | AIza[A-Za-z0-9_-]{35}
    | eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}
    | SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}
    | npm_[A-Za-z0-9]{36} | pypi-[A-Za-z0-9_-]{40,} | hf_[A-Za-z0-9]{30,} | dckr_pat_[A-Za-z0-9_-]{20,}
    | shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32} | sk-(?:proj-|ant-)?[A-Za-z0-9]{20,}[A-Za-z0-9_-]*
    | dop_v1_[a-f0-9]{64} | ya29\.[A-Za-z0-9_-]{20,}
    )""",
    re.X,
)
#: What each of those shapes begins with.
SHAPE_STARTS = [
    b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"github_pat_", b"glpat-", b"xox", b"k_live_", b"k_test_", b"whsec_",
    b"AIza", b"eyJ", b"SG.", b"npm_", b"pypi-", b"hf_", b"dckr_pat_", b"shpat_", b"shpca_", b"shppa_", b"shpss_", b"sk-", b"dop_v1_", b"ya29.",
]
#: The last part of names (lower case) whose values give access. ``pass`` needs a word boundary.
SENSITIVE = (
    rb"(?:passw(?:or[dt]|d)|pass(?:phrase|code|key)|mot_?de_?passe|pass|pwd|kennwort|contrasena|senha|secret|token|credentials?"
    rb"|(?:api|app|access|signing|encryption|account|private|master|auth|shared|service|ssh|license|secret)[_-]?key)(?![a-z0-9_$])"
)
#: A text without one of these holds no sensitive name.
ANCHOR = re.compile(SENSITIVE)
SENSITIVE_END = re.compile(SENSITIVE + rb"\Z")
#: Names of the value of a setting that is a block.
LEAF_NAME = re.compile(rb"(?i)(?:value|default|plain(?:text)?|literal|raw)\Z")
NAME = re.compile(rb"[A-Za-z_$][\w$]*(?:[.-]+[\w$]+)*")
KEY_BLOCK = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_BLOCK_END = re.compile(rb"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
USERINFO = re.compile(rb"://[^\s/\"'`:@<>{}]*:([^\s/\"'`@<>]{3,})@[\w.-]")
HEADER_VALUE = re.compile(rb"[\"'`\s](?:bearer|basic)\s+([a-z0-9._~+/=-]{8,})")
LITERAL = rb"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
#: From the end of a name to the first literal of its value: an optional type, an
#: operator and perhaps a reference that the literal is the fallback of; or a call or list.
VALUE = re.compile(
    rb"""(?P<key>["'`]?)\s*+\]?\s*+
    (?: (?::\s*+[A-Za-z_][\w.<>\[\]|]*+\s*+)?(?::=|===?|!==?|=>|=|:)\s*+
        (?:[A-Za-z_](?:[\w.]|\?\.|\([^()\n]*+\)|\[[^\]\n]*+\])*+\s*+(?:\|\||\?\?|\bor\b|\?:)\s*+)?
      | (?P<call>\(\s*+) | (?P<list>,\s*+) )
    (?:[bruf]{1,2}(?=["']))?(?P<value>""" + LITERAL + rb")",
    re.X | re.S,
)
PIECE = re.compile(rb"\s*(?:\+|\.\s(?=[\"'`])|\\\n)\s*(" + LITERAL + rb")", re.S)
ESCAPED = re.compile(rb"\\([\"'])\s*:\s*\\\1((?:[^\"'\\]|\\(?![\"']).)+?)\\\1")
DEFAULT = re.compile(rb"\s*:-?([^}\"'\s]{4,})\}")
UNQUOTED = re.compile(rb"[ \t]*([:=])[ \t]*([^\s\"'`,;)<>]{4,})")
#: A pair of a connection string, which only a semicolon or the end of the string ends.
PAIR = re.compile(rb"=([^\s\"'`;]{4,})(?=[;\"'`])")
BRACKETS = re.compile(rb"[(){}\[\]]")
#: A line that is nothing but a name, a separator and a value without quotes, and perhaps a comment.
SETTING = re.compile(rb"(?P<gap>[ \t]*)[:=](?P<next>[ \t]*)(?P<value>[^\s\"'`=:>,;][^\s]*)(?=[ \t]*\r?(?:\n|\Z)|[ \t]+(?:#|//|--|;))")
#: What code, rather than a setting, has for a value: a name or type, a call or list, the open end of an expression.
REFERENCE = re.compile(rb"[A-Za-z_]+\d{0,3}(?:[A-Z_.][A-Za-z_.]*\d{0,3})*")
CALL = re.compile(rb"[&*!]*[A-Za-z_]?[\w.]*[(\[{]")
OPEN_END = re.compile(rb"[,;(\[{)}\]|&+\\\"'`]$")
SIGN_INSIDE = re.compile(rb"\d|\w[!@#$%^~]+\w")
AFTER_KEY_ID = re.compile(rb"[\"'`]?[\s,;)+]*+(?:[^\n\"'`]*\n)?[^\n\"'`]*(" + LITERAL + rb")")
COMMENT = re.compile(rb"(?<!:)//|#|^\s*\*|/\*|--|<!--")
LEADING = re.compile(rb"^\s*(?:export\s+|-\s+)?$")
#: What a stand-in contains or is.
STAND_IN = re.compile(
    rb"(?i)^(?:<.*>|\[.*\]|\{\{?.*\}?\}|%[\w.]+%|\$\{?[\w.]+\}?|@[\w.]+@|__\w+__|#\{.*\})$"
    rb"|change[-_ ]?(?:me|it)|replace[-_ ]?(?:me|this|with)|your[-_ ]|placeholder|dummy|redacted|fill[-_ ]?(?:me|in)\b|insert[-_ ]|\bto[-_]?do\b|not[-_]?set|example"
    rb"|^(?:null|none|nil|undefined|true|false|test|testing|secret|password|token|default|empty|n/?a|tbd|foo|bar|foobar|fake|mock\w*|xxx+.*)$"
)
HEADER_NAME = re.compile(rb"^[A-Z][A-Za-z0-9]*(?:-[A-Z][A-Za-z0-9]*)+$")
IDENTIFIER = re.compile(rb"^[a-z][a-z0-9]*(?:[._-][a-z][a-z0-9]*)*$|^[A-Z][A-Z0-9]*(?:_[A-Z][A-Z0-9]*)*$")
#: A setting that is an element: <password>value</password>.
ELEMENT = re.compile(rb"(?:\s[^<>\n]*)?>[ \t]*([^<>\s]{5,})[ \t]*</")
#: A setting named by one attribute and given by another.
ATTRIBUTE = re.compile(rb"[\"']\s+(?P<leaf>value|content)\s*=\s*(?P<value>" + LITERAL + rb")")
#: A block scalar: the value is the first line below, further in than the key.
SCALAR = re.compile(rb"[\"']?[ \t]*:[ \t]*[|>][+-]?[ \t]*\r?\n(?:[ \t]*\r?\n)*(?P<pad>[ \t]+)(?P<body>\S[^\r\n]*?)[ \t]*(?=\r?\n|\Z)")
#: What is bound to a leaf of a block: a literal, or a word up to a blank or bracket.
LEAF_VALUE = re.compile(rb"[\"'`]?[ \t]*(?::|=>?)[ \t]*(?:(?P<quoted>" + LITERAL + rb")|(?P<bare>[^\s\"'`,{}]+))")
#: What key paths are read from: line starts, literals, names, brackets, separators and section headings.
TOKEN = re.compile(
    rb"(?P<section>^\[[\w. -]+\][ \t]*\r?$)|\n(?P<pad>[ \t]*)|(?P<text>" + LITERAL + rb")|(?P<name>[A-Za-z_$][\w$.-]*)|(?P<open>[\[({])|(?P<close>[\])}])|(?P<sep>[:=]+)|(?P<end>[,;])",
    re.M | re.S,
)
#: What stands between the names of a path, and what such a name consists of; a random string has lone lower-case letters.
PATH_BREAK = re.compile(rb"[/._~@%#&-]+")
PATH_NAME = re.compile(rb"[a-z0-9]*|[A-Z0-9]+|(?:v\d++|[A-Z]?[a-z]{2,}+|[A-Z]{1,4}+|\d++)+")
PATTERN_SIGN = re.compile(rb"[\\^$(){}\[\]|*?<>:]")
#: What each byte of a value becomes: a plain scalar in every format, also without quotes.
MASK = b"x"
NOT_LINE_END = re.compile(rb"[^\r\n]")


def _is_path(value: bytes) -> bool:
    """Whether a value that begins with a slash is a path, route or pattern rather than base64 or a password."""
    return bool(PATTERN_SIGN.search(value)) or all(PATH_NAME.fullmatch(part) for part in PATH_BREAK.split(value))


def secret_value(value: bytes) -> bool:
    """Whether a value under a sensitive name is a credential rather than a stand-in, reference or phrase."""
    if len(value) < 5 or len(set(value)) < 4 or re.search(rb"\s", value) or STAND_IN.search(value) or HEADER_NAME.match(value):
        return False
    if b"://" in value or value.startswith((b"data:", b"sha256-", b"sha384-", b"sha512-", b"./", b"../")) or (value.startswith(b"/") and _is_path(value)):
        return False
    if re.search(rb"\$\{|#\{|\{\{|%[sdv]\b|\{\d*\}", value):
        return False
    if re.search(rb"\d", value):
        return not IDENTIFIER.match(value) or bool(re.search(rb"\d{2}|\d[a-z]", value))
    if re.search(rb"[^A-Za-z._/:-]", value):
        return True
    # letters only: in words capitals are few, in random letters they are about half
    upper = len(re.findall(rb"[A-Z]", value))
    return len(value) >= 8 and not IDENTIFIER.match(value) and 4 * upper >= len(value) and 4 * upper <= 3 * len(value)


def _bare_value(value: bytes) -> bool:
    """A stricter test for values without quotes, where a reference to a variable is more likely."""
    if not secret_value(value) or len(value) < 6 or BRACKETS.search(value):
        return False
    return bool(re.search(rb"[^\w.]", value)) or (bool(re.search(rb"\d", value)) and not re.fullmatch(rb"[A-Za-z]+\d?", value))


def _setting_value(value: bytes, tight: bool) -> bool:
    """The test for the value of a line that is a setting and no more; ``tight`` if no blank stands around its ``=``.

    The quoted minimum of five bytes holds. Brackets, commas and the like may be
    part of the value; what may as well be a reference, type or call is left out.
    """
    if not secret_value(value) or OPEN_END.search(value) or not SIGN_INSIDE.search(value) or b"$(" in value:
        return False
    if CALL.match(value) and all(value.count(pair[:1]) == value.count(pair[1:]) for pair in (b"()", b"[]", b"{}")):
        return False
    if re.fullmatch(rb"[A-Za-z]+\d?" if tight else REFERENCE, value):
        return False
    return not re.fullmatch(rb"[A-Za-z_]\w*(?:\??\.[A-Za-z_]\w*)+!?", value)


def walk(text: bytes) -> Iterator[tuple[str, int, int, list[tuple[int, bytes]], bytes]]:
    """The names and literals of ``text`` in order, each with the blocks around it and the key it is bound to.

    Yields (kind, start, stop, scopes, key), kind being ``name`` or ``text``;
    ``scopes`` is a list that goes on changing. Blocks are brackets of any kind,
    indentation below a key and headings in square brackets, so that maps,
    calls, classes and the usual configuration formats are read alike.
    """
    scopes: list[tuple[int, bytes]] = []
    name = key = b""
    kind, typed, called = "", False, b""
    indent = len(text) - len(text.lstrip(b" \t"))
    for m in TOKEN.finditer(text):
        before, kind = kind, m.lastgroup
        token = m.group(kind)
        if kind in ("name", "text"):
            yield kind, m.start(), m.end(), scopes, key
        if kind == "section":
            scopes[:], name, key = [(-1, token.strip()[1:-1])], b"", b""
        elif kind == "pad":
            if text[m.end() : m.end() + 1] not in (b"\r", b"\n", b""):
                if before == "sep" and len(token) > indent:
                    scopes.append((indent, key))
                    key = b""
                while scopes and scopes[-1][0] >= len(token):
                    scopes.pop()
                indent = len(token)
            kind = before
        elif kind == "name":
            name = token
        elif kind == "text":
            called, name = (token[1:-1] if key == b"name" else called), token[1:-1]
        elif kind == "open":
            scopes.append((-2, (key if before == "sep" else name if before in ("name", "close") else b"")))
            name = key = b""
        elif kind == "close":
            closed = (-2, b"")
            while scopes and (closed := scopes.pop())[0] >= -1:
                pass
            name, key = closed[1] if token == b")" else b"", b""
        elif kind == "sep":
            attribute = called and name in (b"value", b"content")
            key = called + b"." + name if attribute else key if token == b"=" and before == "name" and typed and not _sensitive(name) else name
            called = called if name == b"name" else b""
        elif token == b"," and before == "text" and scopes and scopes[-1][0] == -2:
            key = name
        else:
            key = b""
        if kind in ("sep", "end", "open", "close", "section"):
            typed = token == b":"


def _sensitive(name: bytes) -> bool:
    """Whether a name ends in a word whose values give access."""
    m = SENSITIVE_END.search(name.lower())
    if not m or m.group() != b"pass":
        return bool(m)
    at, before = m.start(), name[m.start() - 1 : m.start()]
    return not before.isalnum() or (name[at : at + 1] == b"P" and before.islower())


def keys(text: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, begin, end) of every name in ``text`` that is or stands below a sensitive one.

    ``begin`` and ``end`` are the byte offsets of the name, the last of the
    path. Names in literals and comments are read like others, so that a setting
    inside a string has the string's own key above it.
    """
    for kind, start, stop, scopes, key in walk(text):
        inner = kind == "text"
        if inner and not ANCHOR.search(text[start:stop].lower()) and not LEAF_NAME.match(text, start + 1, stop - 1):
            continue
        for m in NAME.finditer(text, start + inner, stop - inner):
            own = m.group()
            own_is = _sensitive(own)
            if own_is or (LEAF_NAME.match(own) and scopes and _sensitive(scopes[-1][1])):
                # an attribute called name is not part of a path, what it names is
                above = [part for _, part in scopes] + ([key] if inner and key != b"name" else [])
                yield (*(part for part in above if part), own), m.start(), m.end()


def _bound(text: bytes, path: tuple[bytes, ...], begin: int, end: int) -> Iterator[tuple[tuple[bytes, ...], list[tuple[int, int]]]]:
    """(path, spans of its pieces) of the values that stand behind a sensitive key, if their shape is right."""
    if not _sensitive(path[-1]):
        # a leaf of the block that the sensitive name above is
        if m := LEAF_VALUE.match(text, end):
            quoted = m.lastgroup == "quoted"
            start, stop = m.start(m.lastgroup) + quoted, m.end(m.lastgroup) - quoted
            if secret_value(text[start:stop]):
                yield path, [(start, stop)]
        return
    if text[begin - 1 : begin] == b"<" and (m := ELEMENT.match(text, end)) and secret_value(m.group(1)):
        yield path, [m.span(1)]
    if (m := ATTRIBUTE.match(text, end)) and secret_value(m.group("value")[1:-1]):
        yield (*path, m.group("leaf")), [(m.start("value") + 1, m.end("value") - 1)]
    if m := SCALAR.match(text, end):
        line = text[text.rfind(b"\n", 0, begin) + 1 : begin]
        if len(m.group("pad")) > len(line) - len(line.lstrip(b" \t")) and secret_value(m.group("body")):
            yield path, [m.span("body")]
    follow = text[end : end + 1]
    if follow == b"" or follow in b".)}>+*/?&|":
        return
    m = VALUE.match(text, end)
    if m and (m.group("list") is None or m.group("key")):
        pieces = [(m.start("value") + 1, m.end("value") - 1)]
        more = PIECE.match(text, m.end("value"))
        while more:
            pieces.append((more.start(1) + 1, more.end(1) - 1))
            more = PIECE.match(text, more.end(1))
        if secret_value(b"".join(text[a:b] for a, b in pieces)):
            yield path, pieces
        return
    if (m := ESCAPED.match(text, end)) and secret_value(m.group(2)):
        yield path, [m.span(2)]
    line = text.rfind(b"\n", 0, begin) + 1
    if (m := DEFAULT.match(text, end)) and text.rfind(b"${", line, begin) > text.rfind(b"}", line, begin) and secret_value(m.group(1)):
        yield path, [m.span(1)]
    prefix, edge = text[line:begin], text[begin - 1 : begin] if begin > line else b""
    m, setting = UNQUOTED.match(text, end), SETTING.match(text, end)
    if setting and LEADING.match(prefix) and _setting_value(setting.group("value"), text[setting.end("gap") : setting.start("value")] == b"=" and not setting.group("gap")):
        yield path, [setting.span("value")]
    if edge and edge in b";\"'`" and (pair := PAIR.match(text, end)) and not CALL.match(pair.group(1)) and _bare_value(BRACKETS.sub(b"", pair.group(1))):
        yield path, [pair.span(1)]
    elif m:
        stop = m.end(2)
        if edge in (b"?", b"&"):
            # in the query of an address the next parameter ends the value
            stop = m.start(2) + (m.group(2) + b"&").index(b"&")
        value = text[m.start(2) : stop]
        if len(value) >= 4 and _bare_value(value):
            whole = text[stop : stop + 2].lstrip(b"\r")[:1] in (b"", b"\n")
            if COMMENT.search(prefix) or (m.group(1) == b"=" and edge and edge in b";?&\"'`") or (LEADING.match(prefix) and whole and len(value) >= 12):
                yield path, [(m.start(2), stop)]


def find_credentials(text: bytes) -> list[tuple[int, int, int]]:
    """(place, start, stop) of each credential: where it begins, and the bytes to mask.

    ``place`` is -1 for the later pieces of one literal. A value is found once,
    whatever rules meet at it; spans never overlap and are in order. The whole
    text is read, however long it or its lines are. Offsets are in bytes of UTF-8.
    """
    return [x[:3] for x in find_keyed(text)]


def find_keyed(text: bytes) -> list[tuple[int, int, int, tuple[bytes, ...] | None]]:
    """``find_credentials`` with the key path that each value was found by; null where its shape alone gave it away."""
    found: dict[int, tuple[int, int]] = {}
    named: dict[int, tuple[bytes, ...]] = {}

    def add(start: int, stop: int, place: int | None = None) -> None:
        old = found.get(start)
        if stop > start and (old is None or old[0] < stop):
            found[start] = (stop, start if place is None else place)

    low = text.lower()
    if b"-----BEGIN" in text:
        for m in KEY_BLOCK.finditer(text):
            end, other = KEY_BLOCK_END.search(text, m.end()), KEY_BLOCK.search(text, m.end())
            if end and not (other and other.start() < end.start()):
                add(m.end(), end.start(), m.start())
            else:
                add(m.start(), m.end())
    if any(start in text for start in SHAPE_STARTS):
        for m in SHAPES.finditer(text):
            add(m.start(), m.end())
            if m.group().startswith((b"AKIA", b"ASIA")):
                half = AFTER_KEY_ID.match(text, m.end())
                if half and re.fullmatch(rb"[A-Za-z0-9/+=]{40}", half.group(1)[1:-1]):
                    add(half.start(1) + 1, half.end(1) - 1)
    if b"://" in text and b"@" in text:
        for m in USERINFO.finditer(text):
            if not STAND_IN.search(m.group(1)) and len(set(m.group(1))) > 2 and b"${" not in m.group(1):
                add(m.start(1), m.end(1))
    if b"bearer " in low or b"basic " in low:
        for m in HEADER_VALUE.finditer(low):
            value = text[m.start(1) : m.end(1)]
            if not STAND_IN.search(value) and re.search(rb"\d|[A-Z].*[a-z].*[A-Z]", value) and not IDENTIFIER.match(value):
                add(m.start(1), m.end(1))
    if ANCHOR.search(low):
        for at, begin, end in keys(text):
            for path, pieces in _bound(text, at, begin, end):
                for i, (start, stop) in enumerate(pieces):
                    add(start, stop, None if i == 0 else -1)
                    named.setdefault(start, path)
    done, last = [], -1
    for start, (stop, place) in sorted(found.items()):
        if start >= last:
            done.append((place, start, stop, named.get(start)))
            last = stop
    return done


def key_paths(text: bytes, places: list[int]) -> dict[int, str]:
    """The key path of each place in ``text``: the names of the blocks, sections and keys around it, joined by dots.

    A value that was found by its key has that key's path; any other place has
    the path of the literal that it is in, or that comes next. A place without
    a name around it has an empty path, and no path shows a value.
    """
    paths = {start: path for _, start, _, path in find_keyed(text) if path} if places else {}
    left = sorted(p for p in set(places) if p not in paths)
    for _, _, stop, scopes, key in walk(text) if left else ():
        while left and left[0] < stop:
            paths[left.pop(0)] = tuple(part for part in (*(part for _, part in scopes), key) if part)
        if not left:
            break
    return {p: b".".join(paths.get(p, ())).decode("utf-8", "replace") for p in places}


def credential_lines(text: bytes) -> list[int]:
    """Numbers, from 1, of the lines on which a credential begins; lines end at LF."""
    lines, at, n = [], 0, 1
    for place in sorted(p for p, _, _ in find_credentials(text) if p >= 0):
        n += text.count(b"\n", at, place)
        at = place
        if not lines or lines[-1] != n:
            lines.append(n)
    return lines


def redact(text: bytes) -> bytes:
    """The text with each credential's bytes masked one for one; line ends and all else stay."""
    parts, at = [], 0
    for _, start, stop in find_credentials(text):
        parts += [text[at:start], NOT_LINE_END.sub(MASK, text[start:stop])]
        at = stop
    return b"".join([*parts, text[at:]])


def credential_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, line_no, key_path, start, n_bytes): each masked span with its key path and byte offset.

    ``start`` counts bytes of UTF-8 from 0. The pieces of one literal and the
    body of a key block are a row each. Null and empty texts have none.
    """

    def build(keys: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        at, lines, paths, starts, sizes = [], [], [], [], []
        for i, value in enumerate(texts):
            found = find_credentials(value) if value else []
            named = key_paths(value, [start for _, start, _ in found]) if found else {}
            n, last = 1, 0
            for _, start, stop in found:
                n, last = n + value.count(b"\n", last, start), start
                at.append(i)
                lines.append(n)
                paths.append(named[start])
                starts.append(start)
                sizes.append(stop - start)
        columns = [keys.take(pa.array(at, pa.int64())), pa.array(lines, pa.int32()), pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["row_key", "line_no", "key_path", "start", "n_bytes"])

    return _over_texts(df.where(F.col(text) != ""), key, text, "row_key bigint, line_no int, key_path string, start bigint, n_bytes bigint", build)


def _over_texts(df: DataFrame, key: str, text: str, schema: str, build) -> DataFrame:
    source = df.select(F.col(key).cast("bigint").alias("row_key"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                yield build(part.column(0), part.column(1).cast(pa.large_binary()).to_pylist())

    return source.mapInArrow(run, schema)


def credential_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, line_no): one row for each line on which a literal credential begins.

    Null and empty texts have none; every row counts, repeated keys too.
    """

    def build(keys: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        at, lines = [], []
        for i, value in enumerate(texts):
            for n in credential_lines(value) if value else ():
                at.append(i)
                lines.append(n)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(lines, pa.int32())], names=["row_key", "line_no"])

    return _over_texts(df.where(F.col(text) != ""), key, text, "row_key bigint, line_no int", build)


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, text, n_masked) of every row: the text with its credentials masked.

    A null text stays null. Masking keeps every byte offset, so what stands
    around a value is the same in both texts.
    """

    def build(keys: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        out, count = [], []
        for value in texts:
            found = find_credentials(value) if value else []
            out.append(redact(value) if found else value)
            count.append(len(found))
        clean = pa.array(out, pa.binary())
        return pa.RecordBatch.from_arrays([keys, clean.cast(pa.string()), pa.array(count, pa.int32())], names=["row_key", "text", "n_masked"])

    return _over_texts(df, key, text, "row_key bigint, text string, n_masked int", build)


def corpus_keys(class_info: DataFrame, saved_pattern: DataFrame) -> DataFrame:
    """(tab, row_key, line_no, key_path, start, n_bytes) of every masked span of both tables."""
    files = credential_keys(class_info, "pos", "content").withColumn("tab", F.lit("class_info"))
    return files.unionByName(credential_keys(saved_pattern, "seq", "code").withColumn("tab", F.lit("saved_pattern")))


def corpus_credentials(class_info: DataFrame, saved_pattern: DataFrame) -> DataFrame:
    """(tab, row_key, line_no) over the contents of scanned files and the code of saved patterns."""
    files = credential_rows(class_info, "pos", "content").select(F.lit("class_info").alias("tab"), "row_key", "line_no")
    codes = credential_rows(saved_pattern, "seq", "code").select(F.lit("saved_pattern").alias("tab"), "row_key", "line_no")
    return files.unionByName(codes)


def corpus_redacted(class_info: DataFrame, saved_pattern: DataFrame) -> DataFrame:
    """(tab, row_key, text, n_masked) of every row of both tables."""
    files = redacted(class_info, "pos", "content").select(F.lit("class_info").alias("tab"), "row_key", "text", "n_masked")
    codes = redacted(saved_pattern, "seq", "code").select(F.lit("saved_pattern").alias("tab"), "row_key", "text", "n_masked")
    return files.unionByName(codes)
