"""Secret scan with multipart credential linking (operator 6, DataFrame operations only).

Three strong kinds are always reported. Further parts - identifiers, weak
secrets and endpoints - are reported only when a complementary part lies within
``SCOPE`` code points: an identifier or endpoint beside a secret, a weak secret
beside an identifier or endpoint. The link is an interval join: every candidate's
scope is cut into windows of ``SCOPE`` code points and semi-joined with the
parts of the same document and window.

Positions are code points. Java's split and regexp_extract_all give the text
between and inside the matches; running sums of their lengths, taken in chunks,
give the places, so a text with very many matches costs little more than its
length. The window key spreads a text with many parts over tasks; a window can
hold few parts, as each takes some characters.

Defined results: a null text counts as empty; without spans the lists are empty;
repeated rows get the same spans each; extra columns are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, table

SCOPE = 400
CHUNK = 128

#: The strong kinds in the order of their report.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEY = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"   # runs of 18 or more; shorter runs cannot be part of a longer match
HEX = r"[0-9a-f]{16,}"
#: kinds by number: the strong ones, then the linked ones
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
#: linked kinds
IDENT = (r"(?i)\b(?:access_?key(?:_?id)?|client_?id|user_?(?:name|id)?|login|account(?:_?id)?)"
         r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""")
WEAK = (r"(?i)\b(?:pwd|pass(?:word|wd|phrase)?|credentials?|secret|token|api_?key|(?:private|secret)_?key)"
        r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""")
ENDPOINT = (r"""(?i)\bhttps?://[^\x20\x09-\x0D"'<>]{4,}|"""
            r"""\b(?:host(?:name)?|endpoint|server|bucket|database_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}""")
MARK = "[SECRET]"

SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"


def _spans(text: str, pattern: str, kind: int, guard: str | None = None, group: int = 0, least: int = 0) -> Column:
    """Sorted spans of a pattern's matches in column ``text``; group and least: keep those whose group is long enough."""
    lit = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    test = lit if guard is None else "'" + guard.replace("\\", "\\\\").replace("'", "\\'") + "'"
    sizes = f"""zip_with(transform(split({text}, {lit}, -1), g -> length(g)),
                transform(regexp_extract_all({text}, {lit}, 0), m -> length(m)),
                (g, m) -> named_struct('gap', g, 'len', m))"""
    kept = (f"transform(regexp_extract_all({text}, {lit}, {group}), m -> length(m) >= {least})" if group else None)
    # chunks of CHUNK matches: where each starts, then places inside each
    places = f"""
      aggregate(array({sizes}), cast(array() as {SPAN}), (none, z) -> flatten(zip_with(
        transform(sequence(0, (size(z) - 1) div {CHUNK}), c -> slice(z, c * {CHUNK} + 1, {CHUNK})),
        aggregate(transform(sequence(0, (size(z) - 1) div {CHUNK}), c -> aggregate(slice(z, c * {CHUNK} + 1, {CHUNK}),
                    0L, (s, x) -> s + x.gap + coalesce(x.len, 0))),
                  array(0L), (s, n) -> concat(s, array(element_at(s, -1) + n))),
        (part, at) -> if(part is null, cast(array() as {SPAN}), aggregate(part, named_struct('at', at, 'out', cast(array() as {SPAN})),
          (s, x) -> named_struct('at', s.at + x.gap + coalesce(x.len, 0), 'out', concat(s.out, array(named_struct(
             'start', s.at + x.gap, 'kind', {kind}, 'end', s.at + x.gap + coalesce(x.len, 0))))), s -> s.out)))))"""
    # the last gap has no match: an empty span at the end of the text
    spans = f"filter({places}, s -> s.end > s.start)"
    if kept:
        spans = f"""aggregate(array(named_struct('s', {spans}, 'k', {kept})), cast(array() as {SPAN}),
                    (none, z) -> filter(z.s, (x, i) -> z.k[i]))"""
    return F.expr(f"if({text} rlike {test}, {spans}, cast(array() as {SPAN}))")


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per document: ``keep``, base (sorted strong spans) and linked (sorted further spans).

    ``keep`` must identify what the caller wants to tell apart; rows equal in
    ``keep`` and text share their spans.
    """
    inner = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, inner)], F.coalesce(text_col, F.lit("")).alias("_t"))
    found = checkpointed(
        src.select(*inner, F.xxhash64("_t").alias("h"), F.length("_t").alias("n"),
                   F.array_sort(F.concat(_spans("_t", ASSIGN, 0, ASSIGN_KEY, 2, ASSIGN_LEAST),
                                         _spans("_t", ACCESS, 1), _spans("_t", HEX, 2))).alias("base"),
                   F.concat(_spans("_t", IDENT, 3), _spans("_t", WEAK, 4), _spans("_t", ENDPOINT, 5)).alias("more")))
    key = [*inner, "h", "n"]
    # a further part that overlaps a strong span adds nothing; it is found as that span
    parts = found.where(F.size("more") > 0).dropDuplicates(key)
    own = parts.select(*key, F.explode(F.concat("base", "more")).alias("p")).select(*key, "p.*")
    # roles: 1 identifier, 2 secret, 4 endpoint; an access key id is an identifier
    role = F.element_at(F.array(*[F.lit(x) for x in (2, 1, 2, 1, 2, 4)]), F.col("kind") + 1)
    window = lambda at: F.floor(at / SCOPE).cast("long")
    near = own.select(*key, role.alias("role"), F.col("start").alias("s2"), F.col("end").alias("e2"),
                      F.explode(F.sequence(window(F.col("start")), window(F.col("end") - 1))).alias("w"))
    cand = own.where("kind >= 3").withColumn("role", role).withColumn(
        "w", F.explode(F.sequence(window(F.greatest(F.col("start") - SCOPE, F.lit(0))), window(F.col("end") + SCOPE))))
    fits = (((F.col("c.role") == 2) & (F.col("p.role") != 2)) | ((F.col("c.role") != 2) & (F.col("p.role") == 2)))
    same = F.col("c.w") == F.col("p.w")
    for k in key:
        same &= F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    apart = (F.col("p.e2") <= F.col("c.start")) | (F.col("p.s2") >= F.col("c.end"))
    linked = (cand.alias("c").join(near.alias("p"), same & fits & apart & (F.col("p.s2") <= F.col("c.end") + SCOPE)
                                   & (F.col("p.e2") >= F.col("c.start") - SCOPE), "left_semi")
              .groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked")))
    same = F.lit(True)
    for k in key:
        same &= F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}"))
    # a linked part inside a strong span is that span
    fresh = F.expr("filter(linked, l -> not exists(base, b -> b.start < l.end and l.start < b.end))")
    return (found.alias("f").join(linked.alias("l"), same, "left")
            .select(*[F.col(f"f.{k}").alias(c) for c, k in zip(keep, inner)], "f.h", "f.n", "base",
                    F.coalesce(fresh, F.expr(f"cast(array() as {SPAN})")).alias("linked")))


def op6_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)")
    return found.withColumn("every", F.array_sort(F.concat("base", "linked"))).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("every").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts with every strong span replaced by ``MARK``; other texts stay as they are.

    Works on the strings between matches; rows keep all their columns.
    """
    lit = "'" + ASSIGN.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cols = docs.columns
    t = f"`{text_col}`"
    assigned = F.expr(f"""if({t} rlike '{ASSIGN_KEY.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'")}',
        array_join(zip_with(split({t}, {lit}, -1),
          zip_with(regexp_extract_all({t}, {lit}, 0), regexp_extract_all({t}, {lit}, 2),
                   (m, v) -> if(length(v) >= {ASSIGN_LEAST}, '{MARK}', m)), (g, m) -> concat(g, coalesce(m, ''))), ''), {t})""")
    clean = F.regexp_replace(F.regexp_replace(assigned, ACCESS, "\\[SECRET\\]"), HEX, "\\[SECRET\\]")
    return docs.select(*[clean.alias(c) if c == text_col else F.col(c) for c in cols])


def cut_spans(text: str, spans: str) -> Column:
    """Column ``text`` with the places of the sorted ``spans`` replaced by ``MARK``; overlapping spans are one.

    Spans are taken in chunks: a chunk's stretch of text is cut out once, its
    pieces from that stretch.
    """
    chunk = f"transform(sequence(0, (size({spans}) - 1) div {CHUNK}), c -> slice({spans}, c * {CHUNK} + 1, {CHUNK}))"
    # where each chunk starts: the end of all before it
    reach = f"""aggregate({chunk}, array(0L), (s, c) -> concat(s, array(greatest(element_at(s, -1),
                array_max(transform(c, x -> x.end))))))"""
    # a piece up to each span that starts behind all before it; the spans that overlap those only move on
    pieces = f"""zip_with({chunk}, {reach}, (part, from) -> if(part is null,
          named_struct('at', from, 'out', cast(array() as array<string>)),
          transform(array(substring({text}, cast(from + 1 as int), cast(greatest(array_max(transform(part, x -> x.end)) - from, 0) as int))),
            sub -> aggregate(part, named_struct('at', from, 'out', cast(array() as array<string>)), (s, x) -> named_struct(
              'at', greatest(s.at, x.end), 'out', concat(s.out, array(if(x.start >= s.at,
                concat(substring(sub, cast(s.at - from + 1 as int), cast(x.start - s.at as int)), '{MARK}'), ''))))))[0]))"""
    tail = f"substring({text}, cast(array_max(transform({spans}, x -> x.end)) + 1 as int))"
    return F.expr(f"if(size({spans}) = 0, {text}, concat(array_join(flatten(transform({pieces}, p -> p.out)), ''), {tail}))")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced in the texts; every document stays.

    Texts without linked parts lose their strong spans by the patterns; texts with
    linked secrets lose both by position. Identifiers and endpoints stay: alone
    they open nothing.
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(*cols)
    weak = F.filter("linked", lambda x: x["kind"] == KINDS.index("weak"))
    found = scan(docs).where(F.size(weak) > 0).select(
        "doc_id", "h", "n", F.array_sort(F.concat("base", weak)).alias("_spans")).distinct()
    keyed = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(
        "_n", F.length(F.coalesce("text", F.lit(""))))
    joined = (keyed.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
                                    & (F.col("_h") == F.col("h")) & (F.col("_n") == F.col("n")), "left")
              .select(*[F.col(f"d.{c}").alias(c) for c in cols], "_spans"))
    plain = redact(joined.withColumn("_whole", F.col("text")))
    changed = plain.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut_spans("_whole", "_spans")))
    return changed.select(*[F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")).alias(c)
                            if c == "n_chars" else F.col(c) for c in cols])
