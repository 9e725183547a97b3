"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests.

A run of at least 20 characters of an encoding's alphabet is a candidate when it mixes digits and letters. Its encoding is
inferred from its characters (hex, base32, base62 or base64). Three tests ask whether its characters could be drawn
evenly and independently from that alphabet: chi-squared uniformity, runs above and below the middle of the alphabet, and
serial correlation of neighbours. The smallest of the three p-values, times three, is the candidate's p-value. The
Benjamini-Hochberg procedure over the candidates of one text, with weights in proportion to their
lengths (longer strings give the tests more power and are dismissed more readily), dismisses what is not
random, so that at most ``q`` of the dismissed are expected to be random after all. What is left is a span of kind
``random``.

Everything is a column expression over one row; no Python runs and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds. Letters of the key words count in either case.
KEYWORDS = (
    "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
)
ASSIGN = rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGNED = 6
# A run shorter than the least length holds no other match, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
# Characters by value: 16, 32, 62 and 64 of them.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
FALSE_DISCOVERY = 0.01
# Neighbours are multiplied within blocks, so that one block's characters are in memory at a time.
BLOCK = 4096
# Positions are summed in groups, so that their number enters in proportion.
GROUP = 256


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Column ``name``: array of (s, e, m) of every match in ``_text``; empty without any."""
    quoted = _quoted(pattern)
    kind = "array<struct<s: bigint, e: bigint, m: string>>"
    df = df.withColumn("_m", F.expr(f"regexp_extract_all(_text, {quoted}, 0)"))
    df = df.withColumn("_z", F.expr(f"if(size(_m) = 0, null, zip_with(slice(split(_text, {quoted}, -1), 1, size(_m)), _m, (p, m) -> struct(p, m)))"))
    df = df.withColumn(
        "_g", F.expr(f"transform(sequence(0, (size(_m) - 1) div {GROUP}), b -> slice(_z, b * {GROUP} + 1, {GROUP}))")
    )
    step = (
        "(a, x) -> named_struct('pos', a.pos + length(x.p) + length(x.m), 'out', concat(a.out,"
        " array(named_struct('s', a.pos + length(x.p), 'e', a.pos + length(x.p) + length(x.m), 'm', x.m))))"
    )
    inner = f"aggregate(g, named_struct('pos', acc.pos, 'out', cast(array() as {kind})), {step})"
    joined = f"transform(array({inner}), y -> named_struct('pos', y.pos, 'out', concat(acc.out, array(y.out))))[0]"
    start = f"named_struct('pos', 0L, 'out', cast(array() as array<{kind}>))"
    spans = f"flatten(aggregate(_g, {start}, (acc, g) -> {joined}).out)"
    return df.withColumn(name, F.expr(f"if(size(_m) = 0, cast(array() as {kind}), {spans})")).drop("_m", "_z", "_g")


def _upper_tail(z: str) -> str:
    """SQL for the upper tail of the normal distribution; a polynomial with an error under 1e-7."""
    # The usual coefficients of this approximation of the normal distribution.
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    series = (
        f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    )
    tail = f"(exp(-0.5D * ({z}) * ({z})) * 0.3989422804014327D * ({series}))"
    return f"if({z} >= 0, {tail}, 1 - {tail})"


def _battery(df: DataFrame) -> DataFrame:
    """Column ``_random``: the candidates that are not dismissed, as an array of (s, e, m)."""
    kind = "array<struct<s: bigint, e: bigint, m: string>>"
    mixed = "x -> x.m rlike '[0-9]' and x.m rlike '[A-Za-z]'"
    df = _located(df, TOKEN, "_tokens")
    df = df.withColumn("_tokens", F.expr(f"filter(_tokens, {mixed})"))
    # c: the token in the alphabet's own characters; a: the alphabet.
    inferred = (
        f"case when lower(x.m) rlike '^[0-9a-f]+$' and (x.m = lower(x.m) or x.m = upper(x.m))"
        f" then named_struct('c', lower(x.m), 'a', '{ALPHABETS['hex']}')"
        f" when x.m rlike '^[A-Z2-7]+$' then named_struct('c', x.m, 'a', '{ALPHABETS['base32']}')"
        f" when x.m rlike '^[A-Za-z0-9]+$' then named_struct('c', x.m, 'a', '{ALPHABETS['base62']}')"
        f" else named_struct('c', translate(x.m, '-_', '+/'), 'a', '{ALPHABETS['base64']}') end"
    )
    df = df.withColumn("_in", F.expr(f"transform(_tokens, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'i', {inferred}))"))
    n, size = "length(x.i.c)", "length(x.i.a)"
    counts = f"transform(split(x.i.a, ''), c -> cast({n} - length(replace(x.i.c, c, '')) as double))"
    bits = "translate(x.i.c, x.i.a, concat(repeat('0', length(x.i.a) div 2), repeat('1', length(x.i.a) - length(x.i.a) div 2)))"
    values = "transform(split(b, ''), c -> cast(instr(x.i.a, c) as double))"
    products = (
        f"aggregate(regexp_extract_all(x.i.c, '.{{1,{BLOCK}}}', 0), 0D, (t, b) -> t + aggregate(transform(array({values}),"
        " v -> aggregate(transform(slice(v, 1, size(v) - 1), (p, k) -> p * v[k + 1]), 0D, (u, q) -> u + q))[0:1], 0D, (u, q) -> u + q))"
    ).replace("[0:1]", "")
    df = df.withColumn(
        "_facts",
        F.expr(
            f"transform(_in, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'n', cast({n} as double), 'a', cast({size} as double),"
            f" 'counts', {counts}, 'bits', {bits}, 'products', {products}))"
        ),
    )
    df = df.withColumn(
        "_facts",
        F.expr(
            "transform(_facts, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'n', x.n, 'a', x.a,"
            " 'squares', aggregate(x.counts, 0D, (t, c) -> t + c * c),"
            " 'ones', cast(length(replace(x.bits, '0', '')) as double),"
            " 'runs', cast(length(regexp_replace(x.bits, '0+|1+', 'x')) as double),"
            " 'sum1', aggregate(transform(x.counts, (c, k) -> c * (k + 1)), 0D, (t, c) -> t + c),"
            " 'sum2', aggregate(transform(x.counts, (c, k) -> c * (k + 1) * (k + 1)), 0D, (t, c) -> t + c),"
            f" 'pairs', x.n - ceil(x.n / {BLOCK}), 'products', x.products))"
        ),
    )
    chi = "(x.a / x.n * x.squares - x.n - (x.a - 1)) / sqrt(2 * (x.a - 1) * (x.n - 1) / x.n)"
    mean = "(2 * x.ones * (x.n - x.ones) / x.n + 1)"
    runs = f"coalesce((x.runs - {mean}) / sqrt(nullif(({mean} - 1) * ({mean} - 2) / (x.n - 1), 0)), 40D)"
    spread = "(x.sum2 / x.n - x.sum1 / x.n * x.sum1 / x.n)"
    serial = f"coalesce(((x.products / x.pairs - x.sum1 / x.n * x.sum1 / x.n) / nullif({spread}, 0) + 1 / (x.n - 1)) * sqrt(x.n), 40D)"
    df = df.withColumn(
        "_z", F.expr(f"transform(_facts, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'n', x.n, 'chi', {chi}, 'runs', abs({runs}), 'serial', abs({serial})))")
    )
    p = f"least(1D, 3 * least({_upper_tail('x.chi')}, 2 * ({_upper_tail('x.runs')}), 2 * ({_upper_tail('x.serial')})))"
    df = df.withColumn("_mean", F.expr("aggregate(_z, 0D, (t, x) -> t + x.n) / greatest(size(_z), 1)"))
    df = df.withColumn("_p", F.expr(f"sort_array(transform(_z, x -> named_struct('p', {p} * _mean / x.n, 's', x.s, 'e', x.e, 'm', x.m)))"))
    df = df.withColumn(
        "_dismissed",
        F.expr(f"coalesce(array_max(transform(_p, (x, k) -> if(x.p <= {FALSE_DISCOVERY}D * (k + 1) / size(_p), k + 1, 0))), 0)"),
    )
    kept = "transform(filter(_p, (x, k) -> k >= _dismissed), x -> named_struct('s', x.s, 'e', x.e, 'm', x.m))"
    df = df.withColumn("_random", F.expr(f"sort_array(cast({kept} as {kind}))"))
    return df.drop("_tokens", "_in", "_facts", "_z", "_mean", "_p", "_dismissed")


def _find(docs: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """``_keep_i`` columns, ``_text``, n_assign, n_access, n_hex, ``_base`` and ``_all``: arrays of (s, k, e) in order."""
    df = docs.select(
        *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
    )
    df = _located(df, ASSIGN, "_assign")
    long_enough = f"x -> length(regexp_extract(x.m, {_quoted(ASSIGN)}, 1)) >= {MIN_ASSIGNED}"
    df = df.withColumn("_assign", F.expr(f"filter(_assign, {long_enough})"))
    df = _located(_located(df, ACCESS, "_access"), HEX, "_hex")
    df = _battery(df)

    def spans(column: str, kind: int) -> str:
        return f"transform({column}, x -> named_struct('s', x.s, 'k', {kind}, 'e', x.e))"

    base = f"concat({spans('_assign', 0)}, {spans('_access', 1)}, {spans('_hex', 2)})"
    df = df.withColumn("_base", F.expr(f"sort_array({base})"))
    return df.withColumn("_all", F.expr(f"sort_array(concat(_base, {spans('_random', 3)}))"))


def _written(column: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({column}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Spans are ``kind:start:end`` in order of start, then of kind as in ``KINDS``; positions count characters and the
    end is exclusive. Kinds may overlap. A null or empty text has none; base_sha256 is then that of an empty string.
    Repeated rows are searched each; other columns of ``docs`` are not read.
    """
    df = _find(docs, keep, text)
    return df.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.expr(_written("_base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_written("_all")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every span of their text replaced by ``mark``; overlapping spans count as one.

    ``length``, if it is a column, is set to the new number of characters where a text was changed. Other columns and
    texts without spans, null ones included, stay as they are.
    """
    df = _find(docs, tuple(docs.columns), text)
    # A span that starts before the end of those before it only lengthens them. Spans are merged in groups, and the text is cut
    # as an array of characters, so that the work is in proportion to both.
    span = "struct<s: bigint, e: bigint>"
    df = df.withColumn(
        "_groups",
        F.expr(f"if(size(_all) = 0, null, transform(sequence(0, (size(_all) - 1) div {GROUP}), b -> slice(_all, cast(b * {GROUP} + 1 as int), {GROUP})))"),
    )
    step = (
        "(t, x) -> if(x.s <= t.e, named_struct('s', t.s, 'e', greatest(t.e, x.e), 'kept', t.kept), named_struct('s', x.s, 'e', x.e,"
        " 'kept', if(t.e < 0, t.kept, concat(t.kept, array(named_struct('s', t.s, 'e', t.e))))))"
    )
    merge = (
        f"aggregate(_groups, named_struct('s', -1L, 'e', -1L, 'kept', cast(array() as array<array<{span}>>)), (acc, g) -> aggregate(g,"
        f" named_struct('s', acc.s, 'e', acc.e, 'kept', cast(array() as array<{span}>)), {step},"
        " t -> named_struct('s', t.s, 'e', t.e, 'kept', concat(acc.kept, array(t.kept)))),"
        " acc -> concat(flatten(acc.kept), array(named_struct('s', acc.s, 'e', acc.e))))"
    )
    df = df.withColumn("_cuts", F.expr(f"if(size(_all) = 0, cast(array() as array<{span}>), {merge})"))
    df = df.withColumn("_chars", F.expr("if(size(_cuts) = 0, null, split(_text, ''))"))
    pieces = (
        "concat(transform(_cuts, (x, k) -> concat(array_join(slice(_chars, cast(coalesce(get(_cuts, k - 1).e, 0L) + 1 as int),"
        " cast(x.s - coalesce(get(_cuts, k - 1).e, 0L) as int)), ''), {mark})),"
        " array(array_join(slice(_chars, cast(element_at(_cuts, -1).e + 1 as int), size(_chars)), '')))"
    ).format(mark=_quoted(mark))
    df = df.withColumn("_masked", F.expr(f"if(size(_cuts) = 0, null, array_join({pieces}, ''))"))
    out = []
    for i, c in enumerate(docs.columns):
        own = F.col(f"_keep_{i}")
        if c == text:
            own = F.coalesce(F.col("_masked"), own)
        elif c == length:
            own = F.when(F.col("_masked").isNotNull(), F.length("_masked").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return df.select(*out)
