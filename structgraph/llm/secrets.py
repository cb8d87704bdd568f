"""Secret scans: fixed patterns, and a battery of randomness tests.

Patterns (leftmost, non-overlapping, kind by kind): ``assign``, ``access``,
``hex``.  The battery adds spans of kind ``random``: maximal runs of
``[A-Za-z0-9+/_-]`` of ``LEAST`` characters or more, and the ``=`` behind them,
with at least one digit and one letter.  In a run of letters, digits and
hyphens the hyphens are separators (as in a UUID) and are not tested.  For each
run an encoding is inferred (hex, base32, 36 or 64 symbols) and three tests of
"drawn uniformly from that alphabet" are made:

* chi-squared of the symbol counts against the uniform,
* runs above and below the alphabet's middle,
* serial correlation of neighbouring symbols.

A run is a candidate if none of them rejects at ``REJECT``.  Against chance,
its p-value is the probability that a run of *written language* of its length
looks as uniform (chi-squared of a non-uniform source, which grows with the
length).  False discoveries are held at ``FDR`` by the Benjamini-Hochberg
procedure within each length stratum, over all runs of the corpus.  The
p-values are counted in ``BINS`` bins, rounded up, so the procedure needs one
small table whatever the size of the input, and errs to fewer discoveries.

Null and empty texts have no spans.  Repeated rows and null ids count as any
row.  All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from structgraph.llm.common import free_name, let, running_totals, table

#: The base patterns, in the order that breaks ties.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: A run of 16 or more is what HEX finds with its length test; it is cheaper to look for.
HEX_LONG = "[0-9a-f]{16,}"
LEAST = 20
RUN = "[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST
#: Encodings: name, alphabet, and how far language is from uniform per character: the size of the
#: alphabet times the chance that two characters are equal, less 1.  That chance is 0.066 for letters
#: of written language (its index of coincidence; 0.0625 where case is mixed) and 0.19 for the few
#: letters that words share with hex.
ENCODINGS = (
    ("hex", "0123456789abcdef", 2.0),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789", 1.4),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.0),
)
REJECT = 0.0005
FDR = 0.01
#: Upper ends of the length strata; the last is open.
STRATA = (23, 31, 47, 63)
BINS = 400
BIN_WIDTH = 0.05


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _normal(z: str) -> str:
    """SQL text of the standard normal distribution function (error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(0.3989422804014327 * exp(-{z} * {z} / 2) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"if({z} > 0, 1 - {tail}, {tail})"


def _spans(kind: str, order: int, pattern: str, keep: str) -> str:
    """SQL text: spans of ``pattern`` in ``text`` that pass ``keep`` (of m0, the match, and m2, its second group)."""
    p = _sql(pattern)
    second = f"regexp_extract_all(text, {p}, 2)" if "m2" in keep else "m0s"
    at = running_totals("transform(p, (x, i) -> cast(length(x) + if(i > 0, length(m0s[i - 1]), 0) as bigint))", f"{kind}")
    # before piece i + 1 stand the pieces and matches up to i: its running total
    one = f"named_struct('start', starts[i + 1] + 0L, 'ord', {order}, 'kind', '{kind}', 'stop', starts[i + 1] + length(m0), 'm0', m0, 'm2', m2s[i])"
    body = let(at, "befores", let("transform(befores, (b, i) -> b + length(p[i]) + if(i > 0, length(m0s[i - 1]), 0))", "ends", let("concat(array(0L), ends)", "starts", f"transform(m0s, (m0, i) -> {one})")))
    found = let(f"regexp_extract_all(text, {p}, 0)", "m0s", let(f"split(text, {p}, -1)", "p", let(second, "m2s", body)))
    kept = keep.replace("m0", "s.m0").replace("m2", "s.m2")
    return f"transform(filter({found}, s -> {kept}), s -> named_struct('start', s.start, 'ord', s.ord, 'kind', s.kind, 'stop', s.stop, 'piece', s.m0))"


NONE = "cast(array() as array<struct<start: bigint, ord: int, kind: string, stop: bigint, piece: string>>)"


def _when(test: str, spans: str) -> str:
    return f"if(coalesce({test}, false), {spans}, {NONE})"


def base_spans() -> str:
    """SQL text: the pattern spans of column ``text``."""
    return "concat({}, {}, {})".format(
        _when(f"text rlike {_sql(ASSIGN)}", _spans("assign", 0, ASSIGN, "length(m2) >= 12")),
        _when("contains(text, 'AKIA')", _spans("access", 1, ACCESS, "length(m0) >= 18")),
        _when(f"text rlike {_sql(HEX_LONG)}", _spans("hex", 2, HEX_LONG, "length(m0) >= 16")),
    )


def _battery(x: str) -> str:
    """SQL text: of a run ``x``, its encoding's size and the p-values (0 where no encoding holds)."""
    rows = []
    for name, alphabet, skew in ENCODINGS:
        k = len(alphabet)
        rows.append((name, alphabet, k, skew))
    # the body without padding and separators; else - and _ stand for + and / of the URL-safe alphabet
    body = f"if({x} rlike '^[A-Za-z0-9-]+=*$', translate({x}, '-=', ''), translate(rtrim('=', {x}), '-_', '+/'))"
    choose = "CASE WHEN y rlike '^[0-9a-f]+$' OR y rlike '^[0-9A-F]+$' THEN 0 WHEN y rlike '^[A-Z2-7]+$' THEN 1 WHEN y rlike '^[a-z0-9]+$' OR y rlike '^[A-Z0-9]+$' THEN 2 ELSE 3 END"
    alphabet = "CASE e " + " ".join(f"WHEN {i} THEN '{r[1]}'" for i, r in enumerate(rows)) + " END"
    size = "CASE e " + " ".join(f"WHEN {i} THEN {r[2]}D" for i, r in enumerate(rows)) + " END"
    skew = "CASE e " + " ".join(f"WHEN {i} THEN {r[3]}D" for i, r in enumerate(rows)) + " END"
    # symbols as places in the alphabet, centred: (place + 1/2) / k - 1/2
    letters = "split(CASE WHEN e IN (0, 2) THEN lower(y) ELSE y END, '')"
    places = f"transform({letters}, c -> (instr(a, c) - 0.5D) / k - 0.5D)"
    squares = "aggregate(array_distinct(v), 0D, (t, w) -> t + pow(size(filter(v, q -> q = w)), 2))"
    chi = f"(k / n * {squares} - n)"
    # Wilson and Hilferty: the cube root of chi-squared over its freedom is near normal
    z_chi = f"((pow(greatest({chi}, 0D) / (k - 1), 1D / 3) - (1 - 2D / (9 * (k - 1)))) / sqrt(2D / (9 * (k - 1))))"
    changes = "aggregate(sequence(1, cast(n as int) - 1), 0D, (t, i) -> t + if((v[i] > 0) <> (v[i - 1] > 0), 1, 0))"
    z_runs = f"((({changes}) - (n - 1) / 2) / (sqrt(n - 1) / 2))"
    z_serial = "(aggregate(sequence(1, cast(n as int) - 1), 0D, (t, i) -> t + v[i] * v[i - 1]) * 12 / sqrt(n - 1))"
    z_text = f"(({chi} - (k - 1) - n * d) / sqrt(2 * (k - 1) + 4 * n * d))"
    passed = f"(1 - {_normal('zc')} >= {REJECT} AND 2 * (1 - {_normal('abs(zr)')}) >= {REJECT} AND 2 * (1 - {_normal('abs(zs)')}) >= {REJECT})"
    p = f"named_struct('passed', {passed}, 'p', {_normal('zt')})"
    body4 = let(z_chi, "zc", let(z_runs, "zr", let(z_serial, "zs", let(z_text, "zt", p))))
    body3 = let(places, "v", let("cast(size(v) as double)", "n", body4))
    return let(body, "y", let(choose, "e", let(alphabet, "a", let(size, "k", let(skew, "d", body3)))))


def _stratum(x: str) -> str:
    return "CASE " + " ".join(f"WHEN length({x}) <= {s} THEN {i}" for i, s in enumerate(STRATA)) + f" ELSE {len(STRATA)} END"


def run_spans() -> str:
    """SQL text: the runs of column ``text`` with their test results."""
    mixed = "m0 rlike '[0-9]' AND m0 rlike '[A-Za-z]'"
    spans = _spans("random", 3, RUN, mixed)
    tested = let(_battery("s.piece"), "b", f"named_struct('start', s.start, 'ord', s.ord, 'kind', s.kind, 'stop', s.stop, 'stratum', {_stratum('s.piece')}, 'passed', b.passed, 'bin', cast(least(greatest(floor(-log10(greatest(b.p, 1e-300)) / {BIN_WIDTH}D), 0), {BINS}) as int))")
    none = "cast(array() as array<struct<start: bigint, ord: int, kind: string, stop: bigint, stratum: int, passed: boolean, bin: int>>)"
    return f"if(coalesce(text rlike {_sql(RUN)}, false), transform({spans}, s -> {tested}), {none})"


def discovery_bins(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row, ``bins``: of each stratum, the least bin that is discovered.

    A bin stands for its upper p-value, 10 ** (-bin * width).  Benjamini and
    Hochberg: the largest p-value with p * runs <= fdr * (runs at p or below).
    """
    runs = documents.select(F.explode(F.expr(run_spans())).alias("r")).groupBy("r.stratum", "r.bin").agg(F.count("*").alias("n"))
    of = W.partitionBy("stratum")
    ranked = runs.select("stratum", "bin", F.sum("n").over(of).alias("runs"), F.sum("n").over(of.orderBy(F.desc("bin"))).alias("below"))
    found = ranked.where(F.expr(f"pow(10, -bin * {BIN_WIDTH}D) * runs <= {fdr}D * below")).groupBy("stratum").agg(F.min("bin").alias("least"))
    pick = [F.max(F.when(F.col("stratum") == i, F.col("least"))) for i in range(len(STRATA) + 1)]
    return found.agg(F.array(*[F.coalesce(x, F.lit(BINS + 1)) for x in pick]).alias("bins"))


def scan(documents: DataFrame, fdr: float = FDR, names: tuple[str, str] = ("base", "found")) -> DataFrame:
    """All columns of ``documents`` and ``names``: the spans of the patterns, and all.

    A span is a struct of start, ord, kind, stop (code points, end exclusive).
    Both arrays go by start, then kind.  Columns with these names before are
    replaced; others stay whatever their names.
    """
    docs = documents.drop(*names)
    bins = discovery_bins(docs, fdr).scalar()
    own_base, own_runs, own_bins, random = (free_name(c, [*docs.columns, *names]) for c in ("own_base", "own_runs", "own_bins", "random_spans"))
    own = docs.select("*", F.expr(base_spans()).alias(own_base), F.expr(run_spans()).alias(own_runs), bins.alias(own_bins))
    slim = "named_struct('start', s.start, 'ord', s.ord, 'kind', s.kind, 'stop', s.stop)"
    passed = let(f"`{own_bins}`", "least", f"filter(`{own_runs}`, s -> s.passed AND s.bin >= least[s.stratum])")
    out = own.select(*docs.columns, F.expr(f"sort_array(transform(`{own_base}`, s -> {slim}))").alias(names[0]), F.expr(f"sort_array(transform({passed}, s -> {slim}))").alias(random))
    return out.select(*docs.columns, names[0], F.sort_array(F.concat(names[0], random)).alias(names[1]))


def _text(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.expr(f"cast(size(filter(base, s -> s.ord = {i})) as bigint)").alias(c) for i, c in enumerate(("n_assign", "n_access", "n_hex"))]
    return found.select("doc_id", *n, F.sha2(F.expr(_text("base")), 256).alias("base_sha256"), F.expr(_text("found")).alias("spans"), F.expr("cast(size(found) - size(base) as bigint)").alias("n_random"))


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``documents`` with every span (overlapping ones as one) replaced by ``mark``."""
    base, spans = (free_name(c, documents.columns) for c in ("base", "found"))
    found = scan(documents, names=(base, spans))
    # merge by the furthest end so far; spans go by start, so only the last one can grow
    merged = f"""aggregate(`{spans}`, named_struct('out', cast(array() as array<string>), 'at', 0L, 'start', -1L, 'stop', -1L),
        (t, s) -> CASE WHEN s.start < t.stop THEN named_struct('out', t.out, 'at', t.at, 'start', t.start, 'stop', greatest(t.stop, s.stop))
            ELSE named_struct('out', if(t.start < 0, t.out, concat(t.out, array(substring(text, cast(t.at + 1 as int), cast(t.start - t.at as int))))), 'at', greatest(t.at, t.stop), 'start', s.start, 'stop', s.stop) END,
        t -> concat(t.out, array(substring(text, cast(t.at + 1 as int), cast(t.start - t.at as int)), substring(text, cast(t.stop + 1 as int), 2147483647))))"""
    new = F.when(F.size(spans) > 0, F.array_join(F.expr(merged), mark)).otherwise(F.col("text"))
    return found.select(*[new.alias("text") if c == "text" else F.col(c) for c in documents.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its secrets replaced; n_chars follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
