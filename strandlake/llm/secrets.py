"""Secret scans with multipart credential linking (DataFrame operations only).

Base kinds, leftmost and not overlapping within a kind: ``assign`` (a named value of 6
or more characters), ``access`` (key identifiers) and ``hex`` (runs of 24 or more).

Linking adds weak candidates, which alone mean little: ``weak_id`` (a named account or
client identifier), ``weak_secret`` (a run of 32 or more token characters with letters
and digits, outside every base span) and ``endpoint`` (a URL with a host). Parts play a
role: identifiers (access, weak_id), secrets (assign, hex, weak_secret) and endpoints.
Each part's scope is its span widened by ``scope`` code points. A weak identifier or
endpoint is reported only where a secret's scope meets it, a weak secret only where an
identifier or endpoint does. The spans are interval-joined on (document, bin of
positions): a bin is short and spans of a kind do not overlap, so a bin holds a bounded
number of spans, however long or full the document. Work on one text is in proportion to its length
but for sorting its spans and a small share that grows with the square (n spans: (n / RUN)^2 / 2 steps).

Defined results: null text is like the empty text, which has no spans; positions are
code points, end exclusive; repeated rows each get their spans; other columns pass
through (``scan``'s own outputs replace columns of the same name); an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.plans.shared import discard, written

# Fixed patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
# Hints that save most texts the full patterns.
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""

WEAK_ID = r"""(?i:client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
WEAK_SECRET = r"[A-Za-z0-9+/_=-]{32,}"
ENDPOINT = r"""https?://[A-Za-z0-9.-]+[^\x20\x09-\x0D"'<>]*"""

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "weak_id", "weak_secret", "endpoint")
IDS, SECRETS, ENDPOINTS = ("access", "weak_id"), ("assign", "hex", "weak_secret"), ("endpoint",)
SCOPE = 200
RUN = 256
PIECE = 1024
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column], kind: str = "array<int>") -> Column:
    """The fold of each prefix of an array by an associative ``combine``.

    Appending copies what is there, so prefixes are made within runs of ``RUN`` values, then over the
    runs' totals: n values cost n * RUN / 2 + (n / RUN)^2 / 2 copies instead of n^2 / 2.
    """
    last = lambda a: F.get(a, F.size(a) - 1)
    nothing = F.array().cast(kind)

    def scan(run: Column) -> Column:
        return F.aggregate(run, nothing, lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(combine(last(acc), x))))

    def spread(inner: Column) -> Column:
        def moved(before: Column) -> Column:
            return F.flatten(F.transform(inner, lambda run, k: F.transform(run, lambda v: F.when(k == 0, v).otherwise(combine(F.get(before, k - 1), v)))))

        return _let(scan(F.transform(inner, last)), moved)

    def cut(whole: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / RUN).cast("int")), lambda k: F.slice(whole, k * RUN + 1, F.lit(RUN)))
        return F.when(F.size(whole) == 0, nothing).otherwise(_let(F.transform(runs, scan), spread))

    return _let(values, cut)


def _spans(text: Column, pattern: str, kind: str, hint: str, keep=None, group: int = 0) -> Column:
    """Spans of a pattern in code points: running sums over the lengths of the text's gaps and matches.

    ``keep`` takes (match, group's text) and says which matches stay; those that fail
    still use up their characters. ``hint`` must match wherever the pattern does.
    """

    def placed(found: Column) -> Column:
        sizes = F.transform(found, F.length)
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
        ends = _running(F.zip_with(gaps, sizes, lambda g, m: g + m), lambda x, y: x + y)
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        rows = F.arrays_zip(ends.alias("end"), found.alias("m"), groups.alias("g"))
        rows = F.filter(rows, lambda r: keep(r["m"], r["g"])) if keep is not None else rows
        rank = F.lit(KINDS.index(kind))
        return F.transform(rows, lambda r: F.struct((r["end"] - F.length(r["m"])).alias("start"), rank.alias("rank"), r["end"].alias("end"), F.lit(kind).alias("kind")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(hint), _let(found, placed)).otherwise(F.array().cast(SPAN))


def _apart(tokens: Column, base: Column) -> Column:
    """The spans of ``tokens`` that meet none of ``base``: one sort, then running ends and, from behind, running starts."""
    mark = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("s")))

    def judged(all_: Column) -> Column:
        far = 1 << 30
        ends = _running(F.transform(all_, lambda e: F.when(e["own"], -1).otherwise(e["end"])), F.greatest)
        starts = F.reverse(_running(F.transform(F.reverse(all_), lambda e: F.when(e["own"], far).otherwise(e["start"])), F.least))
        rows = F.arrays_zip(all_.alias("e"), ends.alias("before"), starts.alias("next"))
        free = F.filter(rows, lambda r: r["e"]["own"] & (r["before"] <= r["e"]["start"]) & (r["next"] >= r["e"]["end"]))
        return F.transform(free, lambda r: r["e"]["s"])

    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(_let(F.array_sort(F.concat(mark(base, False), mark(tokens, True))), judged))


def base_spans(text: Column) -> Column:
    """The base kinds' spans, by start and then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, "assign", ASSIGN_HINT, lambda m, g: F.length(g) >= 6, group=2),
            _spans(text, ACCESS, "access", "AKIA[A-Z0-9]", lambda m, g: F.length(m) >= 20),
            _spans(text, HEX, "hex", HEX),
        )
    )


def weak_spans(text: Column, base: Column) -> Column:
    """Weak candidates before linking."""
    text = F.coalesce(text, F.lit(""))
    mixed = lambda m, g: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    tokens = _spans(text, WEAK_SECRET, "weak_secret", WEAK_SECRET, mixed)
    fresh = _let(tokens, lambda t: _apart(t, base))
    return F.concat(_spans(text, WEAK_ID, "weak_id", r"(?i:client_?id|account_?id|user_?name|login)[\"']?\x20*[:=]"), fresh, _spans(text, ENDPOINT, "endpoint", "https?://[A-Za-z0-9.-]"))


def _of(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def link(found: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """The weak spans that stand in the scope of a complementary part, one row a document.

    ``found`` has _key (a document's content key), _base and _weak; the result has _key
    and _linked. Both sides are exploded to the bins that their intervals touch.
    """
    can = (F.size(_of(F.col("_all"), SECRETS)) > 0) & (F.size(_of(F.col("_all"), IDS + ENDPOINTS)) > 0)
    found = found.where(F.size("_weak") > 0).dropDuplicates(["_key"]).withColumn("_all", F.concat("_base", "_weak")).where(can)
    width = max(scope, 1)

    def binned(spans: str, wide: int, as_: str) -> DataFrame:
        rows = found.select("_key", F.explode(spans).alias(as_))
        low, high = F.floor((F.col(f"{as_}.start") - wide) / width), F.floor((F.col(f"{as_}.end") - 1 + wide) / width)
        return rows.withColumn("_bin", F.explode(F.sequence(low, high)))

    weak, part = binned("_weak", 0, "w"), binned("_all", scope, "p")
    is_secret = lambda s: F.col(f"{s}.kind").isin(*SECRETS)
    meets = (F.col("p.start") - scope < F.col("w.end")) & (F.col("w.start") < F.col("p.end") + scope)
    same = (F.col("a._key") == F.col("b._key")) & (F.col("a._bin") == F.col("b._bin"))
    pairs = weak.alias("a").join(part.alias("b"), same & meets & (is_secret("w") != is_secret("p")), "left_semi")
    return pairs.groupBy("_key").agg(F.array_sort(F.collect_set("w")).alias("_linked"))


def content_key(doc_id: Column, text: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def scan(docs: DataFrame, *, scope: int = SCOPE, keep_text: bool = True) -> DataFrame:
    """``docs`` with base_spans and spans (base and linked), arrays of
    (start, rank, end, kind). Without ``keep_text`` only doc_id and these are returned.

    Only documents with weak candidates and both roles are shuffled.
    """
    keep = [c for c in docs.columns if c not in ("base_spans", "spans")]
    text = F.col("text")
    row = F.struct(*[F.col(f"`{c}`") for c in (keep if keep_text else ["doc_id"])]).alias("_row")
    rows = docs.select(row, F.col("doc_id"), text, base_spans(text).alias("_base"))
    rows = rows.withColumn("_weak", weak_spans(text, F.col("_base")))
    rows = rows.select("_row", "_base", "_weak", F.when(F.size("_weak") > 0, content_key(F.col("doc_id"), text)).alias("_key"))
    rows = written(rows, "secret-spans")
    linked = link(rows.select("_key", "_base", "_weak"), scope=scope)
    none = F.array().cast(SPAN)
    alone = rows.where(F.col("_key").isNull()).select("_row", "_base", none.alias("_linked"))
    joined = rows.where(F.col("_key").isNotNull()).join(linked, "_key", "left").select("_row", "_base", F.coalesce("_linked", none).alias("_linked"))
    out = alone.unionAll(joined)
    return out.select("_row.*", F.col("_base").alias("base_spans"), F.array_sort(F.concat("_base", "_linked")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Runs of overlapping spans as (start, end), for spans in order of start."""

    def joined(ends: Column) -> Column:
        heads = F.filter(
            F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), ((i == 0) | (s["start"] >= F.get(ends, i - 1))).alias("head"))), lambda h: h["head"]
        )
        close = lambda heads: F.transform(
            heads, lambda h, k: F.struct(h["start"].alias("start"), F.get(ends, F.coalesce(F.get(heads, k + 1)["i"], F.size(spans)) - 1).alias("end"))
        )
        return _let(heads, close)

    return _let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), joined)


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mask``.

    Text is cut into pieces of ``PIECE`` code points, and each piece meets only the runs that reach into it.
    """
    text = F.coalesce(text, F.lit(""))

    def masked(runs: Column) -> Column:
        def written_out(pieces: Column) -> Column:
            marks = F.concat(
                F.transform(pieces, lambda _, k: F.struct((k * PIECE).alias("at"), F.lit(0).alias("kind"), k.alias("n"))),
                F.transform(runs, lambda r, j: F.struct(r["start"].alias("at"), F.lit(1).alias("kind"), j.alias("n"))),
            )
            places = F.transform(F.array_sort(marks), lambda m, p: F.struct((p - m["n"]).alias("first"), m["kind"].alias("kind")))
            # Of a piece: how many runs start before it.
            return _let(F.filter(places, lambda m: m["kind"] == 0), lambda first: F.array_join(F.transform(pieces, lambda piece, k: cut(piece, k, first)), ""))

        def cut(piece: Column, k: Column, first: Column) -> Column:
            low = F.greatest(F.get(first, k)["first"] - 1, F.lit(0))
            near = F.slice(runs, low + 1, F.coalesce(F.get(first, k + 1)["first"], F.size(runs)) - low)
            own = F.filter(near, lambda r: r["end"] > k * PIECE)

            def step(acc: Column, r: Column) -> Column:
                start = r["start"] - k * PIECE
                gap = F.substring(piece, acc["at"] + 1, F.greatest(start, F.lit(0)) - acc["at"])
                out = F.concat(acc["out"], gap, F.when(start >= 0, F.lit(mask)).otherwise(F.lit("")))
                return F.struct(F.least(r["end"] - k * PIECE, F.lit(PIECE)).alias("at"), out.alias("out"))

            begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
            return F.aggregate(own, begin, step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.lit(PIECE))))

        return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), written_out)

    return F.when(F.size(spans) == 0, text).otherwise(_let(_merged(spans), masked))


def scrub(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the secrets of text masked; columns as in ``docs``, null texts stay null.

    A column n_chars is brought up to date where a text changed.
    """
    out = scan(docs, **options)
    hit = F.size("spans") > 0
    clean = F.when(hit, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = out.withColumn("_clean", clean)
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.col("_clean").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(hit, F.length("_clean").cast(kind)).otherwise(F.col("n_chars")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
