"""Benchmark items in documents, re-parameterised ones too, by canonical templates. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.plans.balance import join_hot
from leadlake.plans.scratch import cut

#: Fewest tokens of an item -> types in its template windows, a third of them at most; and the fewest words an item must have.
WIDTHS = {24: 8, 15: 5, 0: 3}
FEWEST = 6
#: Of the tokens that agree, so many must be words or unchanged values: half of the item's half, or half of this.
WINDOW = 8
#: Share of an item's tokens that must agree with the document.
AGREE = 0.5
#: Bits of the sieve that tells which neighbouring types may stand in an item; a power of two.
SIEVE = 1 << 19
BLANK = r"\x20\x09-\x0D"
#: Behind a token's type; between the words of one value; before a word that begins a sentence; behind a name while marking.
MARK, JOIN, START, END = "\x01", "\x02", "\x03", "\x04"
# Units that may follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "pound",
         "pounds", "ounce", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds",
         "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre",
         "metres", "kilometer", "kilometers", "kilometre", "kilometres", "gram", "grams", "kilogram", "kilograms", "mph", "kmh", "w", "kw", "v", "hz",
         "percent", "degree", "degrees", "dollar", "dollars", "euro", "euros", "cent", "cents")


def marked(text: Column) -> Column:
    """The text's tokens; a name or number reads as its type, a mark and its value.

    A name is a run of words of an upper-case letter and lower-case ones, with only blanks between them and
    within a sentence; a number is digits with separators inside and the unit behind it, spaced or not. The
    rest is lower-cased and loses its signs.
    """
    out = text
    for sign in (MARK, JOIN, START, END):
        out = F.replace(out, F.lit(sign), F.lit(""))
    out = F.regexp_replace(out, rf"(^[{BLANK}]*|[.!?:][^\p{{L}}\p{{N}}{BLANK}]*[{BLANK}]+)(?=\p{{Lu}}\p{{Ll}})", f"$1{START}")
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{BLANK}.,:/%{START}]+", "")
    out = F.regexp_replace(out, rf"{START}?\p{{Lu}}\p{{Ll}}+", f"<name>{MARK}$0{END}")
    out = F.regexp_replace(out, rf"{END}[{BLANK}]*<name>{MARK}(?!{START})", JOIN)
    out = F.replace(out, F.lit(END), F.lit(""))
    out = F.regexp_replace(out, rf"[.,:/%]+([{BLANK}]|$)", "$1")
    out = F.regexp_replace(out, rf"(^|[{BLANK}])[.,:/%]+", "$1")
    out = F.regexp_replace(out, r"[0-9](?:[0-9.,:/]*[0-9])?", f"<num>{MARK}$0")
    out = F.lower(out)
    out = F.regexp_replace(out, rf"(<num>{MARK}[0-9.,:/]+%?)[{BLANK}]*({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?=[{BLANK}]|$)",
                           f"$1{JOIN}$2")
    return F.filter(F.split(F.coalesce(out, F.lit("")), rf"[{BLANK}]+"), lambda t: t != "")


def _type(token: Column) -> Column:
    return F.substring_index(token, MARK, 1)


def _hashes(types: Column) -> Column:
    return F.transform(types, lambda t: F.xxhash64(t))


def _neighbours(hashes: Column) -> Column:
    """A hash of each type and the one behind it."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1)))


def _alone(hash_: Column) -> Column:
    """The same for items of one token."""
    return F.xxhash64(hash_, F.lit("alone"))


def _anchored(keys: DataFrame) -> DataFrame:
    """Item windows (item, i_at, w, hashes, plain) with the pair of neighbouring types by which documents are searched.

    The pair is the rarest of the window: with fewest placeholders, then in fewest windows, then by its hash.
    """
    own = F.when(F.col("w") > 1, F.transform(F.slice(_neighbours(F.col("hashes")), 1, F.greatest(F.col("w") - 1, F.lit(1))), lambda p, k: F.struct(
        (F.get("plain", k) + F.get("plain", k + 1)).alias("holders"), k.alias("k"), p.alias("pair")))).otherwise(
        F.array(F.struct(F.get("plain", F.lit(0)).alias("holders"), F.lit(0).alias("k"), _alone(F.get("hashes", F.lit(0))).alias("pair"))))
    rows = keys.select("item", "i_at", "w", F.xxhash64("w", "hashes").alias("hash"), F.explode(own).alias("p")).select("*", "p.*").drop("p")
    used = rows.groupBy("pair").agg(F.count("*").alias("used"))
    best = rows.join(used, "pair").groupBy("item", "i_at", "w", "hash").agg(F.min(F.struct("holders", "used", "pair", "k")).alias("p"))
    return best.select("item", "i_at", "w", "hash", "p.pair", "p.k")


def _sieve(keys: DataFrame) -> Column:
    """The pairs of ``keys`` as a bit set of fixed size: an array of SIEVE / 32 numbers, whatever the benchmark."""
    at = F.col("pair").bitwiseAND(SIEVE - 1)
    words = keys.groupBy(F.shiftright(at, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pair & 31 AS int))")).alias("bits"))
    bits = {r.word: r.bits for r in words.collect()}  # at most SIEVE / 32 rows
    return F.expr(f"array({', '.join(f'{bits.get(k, 0)}L' for k in range(SIEVE >> 5))})")


def _agreeing() -> Column:
    """(i, d, edge, firm) for each item token that agrees with the document along ``at`` or another alignment of ``near``.

    ``tokens`` are those of the document from ``low`` on, as many as any of the alignments reaches.

    Along another alignment a token agrees only beside one that does too. A token is ``firm`` if both beside it
    agree or are outside the item or the document. ``edge`` is -1 for the item's first token and 1 for its last.
    """
    n, at = F.col("n_tokens"), F.col("at")
    i, d = (lambda j: F.get("i_tokens", j)), (lambda s, j: F.get("tokens", s + j - F.col("low")))
    same = lambda s, j: F.coalesce(_type(i(j)) == _type(d(s, j)), F.lit(False))
    fits = lambda s, j: (j < 0) | (j >= n) | d(s, j).isNull() | same(s, j)

    def one(j: Column) -> Column:
        beside = F.get(F.filter("near", lambda s: same(s, j) & (same(s, j - 1) | same(s, j + 1))), F.lit(0))
        s = F.coalesce(beside, F.when(same(at, j), at))
        edge = F.when(j == 0, -1).when(j == n - 1, 1).otherwise(0)
        return F.struct(i(j).alias("i"), d(s, j).alias("d"), edge.alias("edge"), (fits(s, j - 1) & fits(s, j + 1)).alias("firm"))

    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), one), lambda x: x["d"].isNotNull())


def _slots(x: Column) -> Column:
    """(i, d, firm) for each word of an agreeing placeholder; values of unlike many words stand whole. Words that begin a sentence are not firm."""
    plain = lambda v: F.translate(v, START, "")
    i, d = x["i"], x["d"]
    value = F.substring_index(plain(i), MARK, -1)
    shown = F.substring_index(plain(d), MARK, -1)
    shown = F.when((x["edge"] == -1) & shown.endswith(F.concat(F.lit(JOIN), value)) | (x["edge"] == 1) & shown.startswith(F.concat(value, F.lit(JOIN))), value).otherwise(shown)
    pair = F.arrays_zip(F.split(value, JOIN).alias("i"), F.split(shown, JOIN).alias("d"), F.split(F.substring_index(i, MARK, -1), JOIN).alias("o"))
    alike = F.size(F.split(value, JOIN)) == F.size(F.split(shown, JOIN))
    begins = d.contains(START)
    each = F.transform(pair, lambda p, k: F.struct(p["i"].alias("i"), p["d"].alias("d"), (x["firm"] & ~p["o"].contains(START) & ~(begins & (k == 0))).alias("firm")))
    whole = F.array(F.struct(value.alias("i"), shown.alias("d"), (x["firm"] & ~i.contains(START) & ~begins).alias("firm")))
    return F.when(~i.startswith("<"), F.array().cast("array<struct<i:string,d:string,firm:boolean>>")).when(alike, each).otherwise(whole)


def leaks(docs: DataFrame, benchmark: DataFrame, agree: float = AGREE, fewest: int = FEWEST) -> DataFrame:
    """(doc_id, item_id, at, n_tokens, n_agree, n_slots, n_changed, row): one row per document row and item found in it.

    Texts become templates (:func:`marked`). An item of n tokens has windows of 8 types (5 below 24
    tokens, 3 below 15) at every token, of which those about half of words are taken, or all if there are
    none; a document has windows at every token, so an item standing in it whole, or from 9 tokens in
    thirds with words between, is met.
    Each item window is searched by its rarest pair of neighbouring types: a sieve of fixed size leaves the places of a
    document where such a pair may stand, and only there windows are built. Windows meet by hash; each hit fixes an alignment, and the item's tokens are compared along it and
    along those within n / 2 tokens of it, the nearest first, so that agreement before and behind inserted or left-out words
    adds up. A leak needs ``agree`` of the tokens equal in type and word, of which as many as half a window
    of min(8, (n + 1) / 2) tokens are words or values that did not change. Slots must be consistent: each
    value of the item always stands for the same value of the document, and the other way round. A
    changed slot that contradicts others is left out of ``n_agree`` if it begins a sentence or the tokens
    beside it do not agree; otherwise the question is another one. ``n_changed`` counts slots whose value differs: above
    0, the question was re-parameterised. Of several alignments the one with most agreement counts, then
    the first.

    Items of less than ``fewest`` words are not looked for. Null and empty texts hold nothing. ``row`` is a 128-bit digest of
    id and text, so rows with a null or a repeated id are told apart; equal rows are found alike, once.
    Null item ids are kept. Other columns are not looked at.
    """
    items = benchmark.select("item_id", marked(F.col("text")).alias("i_tokens"), F.xxhash64("item_id", "text").alias("item")).dropDuplicates(["item"])
    words = F.size(F.flatten(F.transform("i_tokens", lambda t: F.split(t, JOIN))))
    items = items.withColumn("n_tokens", F.size("i_tokens")).filter(words >= fewest)
    width = F.lit(WIDTHS[0])
    for least in sorted(WIDTHS)[1:]:
        width = F.when(F.col("n_tokens") >= least, WIDTHS[least]).otherwise(width)
    items = cut(items.withColumn("w", F.least("n_tokens", width)), "items")
    cuts = items.select("item", "w", F.transform("i_tokens", _type).alias("types")).withColumn("hashes", _hashes(F.col("types")))
    cuts = cuts.select("item", "w", F.transform("types", lambda t: t.startswith("<").cast("int")).alias("plain"), "hashes",
                       F.explode(F.sequence(F.lit(0), F.size("types") - F.col("w"))).alias("i_at"))
    part = lambda c: F.slice(c, F.col("i_at") + 1, F.col("w"))
    cuts = cuts.select("item", "w", "i_at", part("plain").alias("plain"), part("hashes").alias("hashes"))
    some = (F.col("w") - F.aggregate("plain", F.lit(0), lambda a, x: a + x)) * 2 >= F.col("w") - 1
    keys = cut(cuts.withColumn("some", some), "item-windows")
    wordy = keys.filter("some").select("item").distinct()
    keys = cut(_anchored(keys.filter("some").unionByName(keys.join(wordy, "item", "left_anti")).drop("some")), "item-keys")
    widths = [r.w for r in keys.select("w").distinct().collect()]  # at most those of WIDTHS, and 1 and 2
    row = _row()
    empty = "doc_id {}, item_id {}, at int, n_tokens int, n_agree int, n_slots int, n_changed int, row string".format(dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"])
    if not widths:
        return docs.sparkSession.createDataFrame([], empty)
    sieve, most = _sieve(keys), max(widths)

    def may(pair: Column) -> Column:
        word = F.get(sieve, F.shiftright(pair.bitwiseAND(SIEVE - 1), 5).cast("int"))
        return F.getbit(word, pair.bitwiseAND(31).cast("int")) == 1

    # Of each place that the sieve leaves: the hashes of the types around it, as far as a window reaches.
    h = F.col("hashes")
    marks = F.transform(_neighbours(h), lambda p, i: F.struct(i.alias("i"), p.alias("pair")))
    if 1 in widths:
        marks = F.concat(marks, F.transform(h, lambda x, i: F.struct(i.alias("i"), _alone(x).alias("pair"))))
    left = F.transform(F.filter(marks, lambda m: may(m["pair"])), lambda m: F.struct(
        m["i"].alias("i"), m["pair"].alias("pair"), F.greatest(m["i"] - (most - 1), F.lit(0)).alias("low"),
        F.slice(h, F.greatest(m["i"] - (most - 1), F.lit(0)) + 1, F.lit(2 * most)).alias("around")))
    pages = docs.select(row.alias("row"), _hashes(F.transform(marked(F.col("text")), _type)).alias("hashes"))
    seen = cut(pages.select("row", F.explode(left).alias("x")).select("row", "x.*"), "sieved")
    met = join_hot(seen, keys, ["pair"], "inner").withColumn("start", F.col("i") - F.col("k")).filter("start >= 0")
    met = met.filter(F.xxhash64("w", F.slice("around", F.col("start") - F.col("low") + 1, F.col("w"))) == F.col("hash"))
    hits = cut(met.select("row", "item", (F.col("start") - F.col("i_at")).alias("at")).distinct(), "hits")
    per_row = hits.groupBy("row", "item").agg(F.sort_array(F.collect_set("at")).alias("ats"))  # at most one per item window and document window
    texts = docs.select("doc_id", row.alias("row"), "text").join(hits.select("row").distinct().hint("merge"), "row", "left_semi")
    texts = texts.dropDuplicates(["row"]).select("row", "doc_id", marked(F.col("text")).alias("tokens"))
    pairs = per_row.join(texts, "row").join(items, "item").withColumn("half", F.expr("n_tokens div 2"))

    def near(at: Column, k: Column) -> Column:
        # Starts are distinct and sorted, so those within half an item are among so many before and behind.
        some = F.slice("ats", F.greatest(k - F.col("half"), F.lit(0)) + 1, 2 * F.col("half") + 1)
        others = F.filter(some, lambda s: F.abs(s - at) <= F.col("half"))
        return F.transform(F.array_sort(F.transform(others, lambda s: F.struct(F.abs(s - at).alias("far"), s.alias("s")))), lambda x: x["s"])

    def view(at: Column, k: Column) -> Column:
        low = F.greatest(at - F.col("half") - 1, F.lit(0))
        return F.struct(at.alias("at"), near(at, k).alias("near"), low.alias("low"),
                        F.slice("tokens", low + 1, F.greatest(at + F.col("n_tokens") + F.col("half") + 2 - low, F.lit(0))).alias("tokens"))

    pairs = pairs.select("row", "doc_id", "item_id", "item", "n_tokens", "i_tokens", F.explode(F.transform("ats", view)).alias("x")).select("*", "x.*").drop("x")
    # Each step is written, as the filters would else evaluate it anew.
    pairs = cut(pairs.withColumn("same", _agreeing()).drop("tokens", "i_tokens", "near", "low"), "alignments").filter(F.size("same") >= F.lit(agree) * F.col("n_tokens"))
    pairs = cut(pairs.withColumn("slots", F.transform("same", _slots)), "slots").withColumn("all", F.array_distinct(F.flatten("slots")))
    against = lambda p, q: (p["i"] == q["i"]) != (p["d"] == q["d"])
    pairs = pairs.filter(~F.exists("all", lambda p: p["firm"] & F.exists("all", lambda q: q["firm"] & against(p, q))))
    pairs = pairs.withColumn("off", F.filter("all", lambda p: ~p["firm"] & (p["i"] != p["d"]) & F.exists("all", lambda q: against(p, q))))
    held = F.filter("slots", lambda s: ~F.arrays_overlap(s, F.col("off")))
    kept = F.filter("all", lambda p: ~F.array_contains("off", p))
    pairs = pairs.withColumn("held", held).withColumn("kept", F.array_distinct(F.transform(kept, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))))).withColumn("n_agree", F.size("held"))
    literal = F.size(F.filter("held", lambda s: ~F.exists(s, lambda p: p["i"] != p["d"])))
    pairs = pairs.filter((F.col("n_agree") >= F.lit(agree) * F.col("n_tokens")) & (literal * 2 >= F.least(F.lit(WINDOW), F.expr("(n_tokens + 1) div 2"))))
    pairs = pairs.select("row", "doc_id", "item_id", "item", "n_tokens", F.struct(
        "n_agree", (-F.col("at")).alias("back"), F.size("kept").alias("n_slots"), F.size(F.filter("kept", lambda x: x["i"] != x["d"])).alias("n_changed")).alias("x"))
    top = pairs.groupBy("row", "doc_id", "item_id", "item", "n_tokens").agg(F.max("x").alias("x"))
    return top.select("doc_id", "item_id", (-F.col("x.back")).alias("at"), "n_tokens", "x.n_agree", "x.n_slots", "x.n_changed", "row")


def _row() -> Column:
    """Two hashes of id and text."""
    return F.concat(F.hex(F.xxhash64("doc_id", "text")), F.lit("-"), F.hex(F.xxhash64(F.lit("row"), "text", "doc_id")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no item was found, with their own columns."""
    name = "leak"
    while name in docs.columns:
        name += "_"
    bad = leaks(docs, benchmark, **how).select(F.col("row").alias(name)).distinct()
    return docs.join(bad, _row() == F.col(name), "left_anti")
