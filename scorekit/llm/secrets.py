"""Secret scans (DataFrame and SQL functions only).

Base rules find assignments, access keys and long hex runs by pattern.  On top of
them, candidate strings of an alphabet that secrets use are scanned with a sliding
window: the Shannon entropy of every window comes from running counts (one
character enters, one leaves), and a candidate whose highest window reaches its
character class's threshold is reported, unless it has no digit or no letter, or an
allow-list pattern matches the whole of it.  Base spans and harmless stretches
(``HARMLESS``) are cut out first; what stands beside them is a candidate of its own.

Each text is read once and no row shuffles; the scan of a candidate is linear in its
length.  Offsets are code points, ends exclusive.

Edge cases: null and empty texts have no spans; rows with null ids, and repeated rows,
are scanned like any other; of spans that start together the kinds' order decides; a very
long text is scanned whole, matches and spans ``CHUNK`` at a time, so that no step copies
more than a chunk; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

# The base rules, in the order in which ties at one start are listed.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs are maximal, so shorter ones may be passed over

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ENTROPY_WINDOW = 20
#: Entropy thresholds in bits a character, by character class.
THRESHOLDS = {"hex": 3.0, "base64": 3.7}
#: Candidates that are no secrets: UUIDs, dates and times, paths and dotted or dashed
#: words, integrity hashes.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9_-]*$",
    r"^[0-9_=+/-]*$",
    r"(?i)^sha(1|256|384|512)-",
    r"^[A-Za-z]+([/_-][A-Za-z]*[0-9]{0,4})+$",
)


def _sequence(chars: str, least: int) -> str:
    """Pattern of the first ``least`` characters or more, in order."""
    rest = ""
    for c in reversed(chars[least:]):
        rest = f"(?:{c}{rest})?"
    return chars[:least] + rest


#: Stretches that are no part of a secret: one character over and over, digits or
#: letters in order, and placeholders that are a whole segment.
HARMLESS = (r"([A-Za-z0-9+/_=-])\1{5,}|(?i:0123456789|"
            + _sequence("abcdefghijklmnopqrstuvwxyz", 8)
            + r"|(?<![A-Za-z0-9])(?:example|sample|dummy|placeholder|changeme|your|x{4,}|lorem)"
            r"(?![A-Za-z0-9]))")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


#: Matches or spans of a text that one inner loop collects.
CHUNK = 256


def _chunks(rows: str) -> str:
    """SQL for an array cut into arrays of ``CHUNK`` elements."""
    return (f"transform(if(size({rows}) = 0, cast(array() as array<int>), "
            f"sequence(0, (size({rows}) - 1) div {CHUNK})), "
            f"c -> slice({rows}, c * {CHUNK} + 1, {CHUNK}))")


def _once(value: str, name: str, then: str) -> str:
    """SQL for ``then``, in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _matches(text: str, pattern: str, group: int) -> str:
    """SQL for ``array<struct<start,end,found,value>>`` of all matches of a pattern, left
    to right: the text between matches gives their places, first within a chunk of matches,
    then from the lengths of the chunks."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found, value = (f"regexp_extract_all({text}, '{p}', {g})" for g in (0, group))
    zipped = (f"filter(transform(arrays_zip(split({text}, '{p}', -1), {found}, {value}), "
              "z -> named_struct('gap', z.`0`, 'found', z.`1`, 'value', z.`2`)), "
              "z -> z.found is not null)")
    empty = "cast(array() as array<struct<start:int,end:int,found:string,value:string>>)"
    within = (f"aggregate(k, named_struct('at', 0, 'out', {empty}), (s, z) -> named_struct("
              "'at', s.at + length(z.gap) + length(z.found), 'out', concat(s.out, array("
              "named_struct('start', s.at + length(z.gap), 'end', s.at + length(z.gap) "
              "+ length(z.found), 'found', z.found, 'value', z.value)))))")
    starts = ("aggregate(ks, named_struct('at', 0, 'out', cast(array() as array<int>)), "
              "(s, k) -> named_struct('at', s.at + k.at, 'out', concat(s.out, array(s.at))), "
              "s -> s.out)")
    moved = (f"flatten(zip_with(ks, {starts}, (k, at) -> transform(k.out, m -> named_struct("
             "'start', m.start + at, 'end', m.end + at, 'found', m.found, 'value', m.value))))")
    return _once(zipped, "zs", _once(f"transform({_chunks('zs')}, k -> {within})", "ks", moved))


def _spans(matches: str, kind: str, least: int) -> str:
    """SQL for the spans of the matches whose counted part is long enough."""
    return (f"transform(filter({matches}, m -> length(m.value) >= {least}), m -> "
            f"named_struct('start', m.start, 'rank', {KINDS.index(kind)}, 'end', m.end, "
            f"'kind', '{kind}'))")


def lowest_sum(value: str, window: int) -> str:
    """SQL for the least ``sum(c * log2(c))`` over the counts ``c`` of the characters in any
    full window of ``value``; null if it is shorter.  Entropy is ``log2(window)`` less this
    sum over ``window``.  Every step changes one count: a character enters, and once the
    window is full and judged, its first one leaves."""
    table = ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 2))
    chars = (f"transform(filter(split({value}, ''), c -> c != ''), "
             f"c -> instr('{ALPHABET}', c))")
    events = (f"flatten(transform({chars}, (p, i) -> if(i + 1 < {window}, array(p), "
              f"array(p, -element_at(a, i + 2 - {window})))))")
    events = f"element_at(transform(array({chars}), a -> {events.replace(chars, 'a')}), 1)"
    count = "element_at(s.n, abs(e))"
    after = f"s.sum + element_at(t, {count} + int(sign(e)) + 1) - element_at(t, {count} + 1)"
    after = after.replace("element_at(t,", f"element_at(array({table}),")
    return (f"aggregate({events}, named_struct('n', array_repeat(0, {len(ALPHABET)}), 'k', 0, "
            "'sum', 0D, 'low', cast(null as double)), (s, e) -> named_struct("
            "'n', transform(s.n, (c, j) -> if(j + 1 = abs(e), c + int(sign(e)), c)), "
            "'k', s.k + int(sign(e)), "
            f"'sum', {after}, "
            f"'low', if(e > 0 and s.k + 1 = {window}, least(s.low, {after}), s.low)), s -> s.low)")


def _blanked(text: str, spans: str) -> str:
    """SQL for the text with a blank for every character of the spans: region by region,
    each from the end of the spans before to that of a chunk of spans."""
    upto = "greatest(s.at, b.start)"
    inner = ("aggregate(r.spans, named_struct('at', r.first, 'out', ''), (s, b) -> "
             "named_struct('at', greatest(s.at, b.end), 'out', concat(s.out, "
             f"substring(t, s.at - r.first + 1, {upto} - s.at), "
             f"repeat(' ', greatest(s.at, b.end) - {upto}))), s -> s.out)")
    region = _once(f"substring({text}, r.first + 1, r.last - r.first)", "t", inner)
    last = "greatest(s.at, array_max(transform(k, b -> b.end)))"
    none = ("cast(array() as array<struct<first:int,last:int,spans:array<struct<"
            "start:int,end:int>>>>)")
    regions = (f"aggregate({_chunks('bs')}, named_struct('at', 0, 'out', {none}), (s, k) -> "
               f"named_struct('at', {last}, 'out', concat(s.out, array(named_struct("
               f"'first', s.at, 'last', {last}, 'spans', k)))), s -> array_join(concat("
               f"transform(s.out, r -> {region}), array(substring({text}, s.at + 1))), ''))")
    return _once(f"array_sort({spans})", "bs", regions)


def _entropy_spans(candidates: str) -> str:
    """SQL for the spans of high-entropy candidates."""
    allowed = " or ".join("rlike(m.value, '" + p.replace("\\", "\\\\") + "')" for p in ALLOWED)
    plausible = ("rlike(m.value, '[0-9]') and rlike(m.value, '[A-Za-z]') and not "
                 f"({allowed})")
    scored = (f"transform(filter({candidates}, m -> {plausible}), m -> named_struct("
              "'start', m.start, 'end', m.end, 'hex', rlike(m.value, '^[0-9A-Fa-f]+$'), "
              f"'bits', {math.log2(ENTROPY_WINDOW)!r}D - "
              f"{lowest_sum('m.value', ENTROPY_WINDOW)} / {ENTROPY_WINDOW}))")
    return (f"transform(filter({scored}, m -> m.bits >= if(m.hex, {THRESHOLDS['hex']}D, "
            f"{THRESHOLDS['base64']}D)), m -> named_struct('start', m.start, 'rank', "
            "if(m.hex, 3, 4), 'end', m.end, 'kind', if(m.hex, 'entropy_hex', "
            "'entropy_base64')))")


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat_ws(':', s.kind, "
                  "cast(s.start as string), cast(s.end as string))), ',')")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text``, ``base`` and ``added``, arrays of spans
    ``(start, rank, end, kind)`` in order."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    lower = ascii_lower(F.col("text"))
    named = lower.contains(ASSIGN_WORDS[0])
    for w in ASSIGN_WORDS[1:]:
        named = named | lower.contains(w)
    rules = (("assign", named, ASSIGN, 2, 6),
             ("access", F.col("text").contains("AKIA"), ACCESS, 0, 20),
             ("hex", F.col("text").rlike(HEX), HEX, 0, 24))
    for kind, likely, pattern, group, least in rules:
        d = d.withColumn(kind, F.when(likely, F.expr(
            _spans(_matches("text", pattern, group), kind, least))).otherwise(none))
    d = d.withColumn("base", F.expr("array_sort(concat(assign, access, hex))"))
    cut = (f"concat(transform(base, b -> named_struct('start', b.start, 'end', b.end)), transform("
           f"{_matches('text', HARMLESS, 0)}, m -> named_struct('start', m.start, 'end', m.end)))")
    d = d.withColumn("rest", F.when(F.col("text").rlike(CANDIDATE), F.expr(
        _blanked("text", cut))).otherwise(""))
    d = d.withColumn("added", F.when(F.col("rest").rlike(CANDIDATE), F.expr(
        _entropy_spans(_matches("rest", CANDIDATE, 0)))).otherwise(none))
    return d.select("doc_id", "text", "base", "added")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    d = scan_secrets(docs, id_col, text_col)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}")
              for k in KINDS[:3]]
    return d.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"),
                    _joined("concat(base, added)").alias("spans"))
