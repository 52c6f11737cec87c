"""Personal data in whole texts: fixed patterns, and bootstrapped contextual extraction; DataFrame functions alone.

The fixed patterns' matches are the seeds.  The words on a seed's left, and those on its right, induce lexical patterns with
its coarse class, its marks or its form; so do the classes of the words beside it, which recur where the words do not.  Its form
alone is a pattern too, counted apart.  A pattern's instances are the identifier-like words, and
runs of words, that fit it anywhere.  Spark scores the bipartite graph of patterns and instances in turns: a pattern is as
trustworthy as the mean of its instances, smoothed towards 0, and an instance as its patterns together.  Instances of patterns
above a threshold that no fixed pattern has found are personal data of the pattern's kind too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the base patterns.  They match what the plain forms match, leftmost and non-overlapping, in time linear in
#: the text and without recursion: loops are possessive where nothing could be given back, and a match starts only where a
#: run starts or the last match ended.  What looks back comes after the first character, which most places fail at.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Words of left or right context in a pattern.
CONTEXT = 2
#: Turns of scoring.
TURNS = 3
#: Distinct instances that a pattern needs among the seeds.
SUPPORT = 3
#: Trust from which a pattern extracts.
TRUST = 0.8
#: Added to a pattern's instances, with trust 0.
SMOOTH = 0.5
_BLANK = r"[ \x09-\x0D]+"
_HITS = "array<struct<rank:int,i:int,gap:int,size:int,found:string,left:string,right:string>>"
_AT, _DOT = r"[\[({](?i:at)[\])}]", r"(?:(?i:dot)|[\[({](?i:dot)[\])}])"
_WORD, _GAP = r"[^ \x09-\x0D]++", r"[ \x09-\x0D]++"
#: An identifier-like word: one with a digit, an at sign or a bracketed at.
MARK = rf"(?<![^ \x09-\x0D])[^ \x09-\x0D0-9@\[({{]*+(?:(?!{_AT})[\[({{][^ \x09-\x0D0-9@\[({{]*+)*+(?:[0-9@]|{_AT})[^ \x09-\x0D]*+"
#: Identifier-like runs of words: words of digits and marks, and addresses with their at (and dots) as words.
RUN = (
    rf"(?<![^ \x09-\x0D])(?:[0-9+(][0-9+().\/-]*+(?:\x20[0-9+().\/-]++(?![^ \x09-\x0D,;:!?]))++"
    rf"|{_WORD}{_GAP}(?:(?i:at){_GAP}{_WORD}(?:{_GAP}{_DOT}{_GAP}{_WORD})++|(?:@|{_AT}){_GAP}{_WORD}(?:{_GAP}{_DOT}{_GAP}{_WORD})*+))"
)
#: Ranks of identifier-like words and runs of words, after those of the kinds.
WORD, SEVERAL = len(KINDS), len(KINDS) + 1
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


#: A cheap test that every text with a match passes.
HINTS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "phone": lambda text: F.contains(text, F.lit("+")),
    WORD: lambda text: text.rlike(rf"[0-9@]|{_AT}"),
}


def _luhn(digits: Column) -> Column:
    places = F.split(F.reverse(digits), "")
    def weigh(total: Column, x: Column, i: Column) -> Column:
        d = F.when(i % 2 == 1, x * 2).otherwise(x)
        return total + F.when(d > 9, d - 9).otherwise(d)
    weighed = F.transform(F.filter(places, lambda x: x != ""), lambda x, i: weigh(F.lit(0), x.cast("int"), i))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _sound(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.ltrim(p, F.lit("0")) <= "255", 3).otherwise(2))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    return F.length(digits).between(8, 15)


def _parted(text: Column, kind: str | int, pattern: str) -> Column:
    """A text cut at a pattern's matches in one pass: what is between them and the matches in turns; 0x01 and 0x02 become 0x03."""
    plain = F.translate(text, "\x01\x02", "\x03\x03")
    cut = F.split(F.regexp_replace(plain, F.lit(pattern), F.lit("\x01$0\x01")), "\x01", -1)
    return F.when(HINTS[kind](text), cut) if kind in HINTS else cut


def _places(parts: Column) -> Column:
    """Numbers of the matches among a text's parts."""
    return F.when(F.size(parts) > 1, F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _hits(parts: Column, rank: int) -> Column:
    """array<struct<rank, i, gap, size, found, left, right>> of a pattern's matches: the characters since the last match, and its own."""
    none = F.lit(None).cast("string")

    def row(i: Column) -> Column:
        own = F.get(parts, 2 * i + 1)
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(F.get(parts, 2 * i)).alias("gap"), F.length(own).alias("size"), own.alias("found"), none.alias("left"), none.alias("right"))

    return F.transform(_places(parts), row)


def _ends(text: Column) -> Column:
    """struct<head, tail> of a text: its first and its last words."""
    split = F.filter(F.split(text, _BLANK), lambda w: w != "")
    cut = lambda w: F.struct(F.slice(w, F.lit(1), F.lit(CONTEXT)).alias("head"), F.slice(w, F.greatest(F.size(w) - (CONTEXT - 1), F.lit(1)), F.lit(CONTEXT)).alias("tail"))
    return F.get(F.transform(F.array(split), cut), F.lit(0))


def _beside(found: Column, ends: Column, rank: int) -> Column:
    """As :func:`_hits`, of matches and the ends of the texts between them, with the words on either side of each match."""
    at = lambda i: F.get(ends, i)
    own = lambda i: F.array(F.coalesce(F.get(found, i), F.lit("")))
    words = lambda *parts: F.filter(F.concat(*parts), lambda w: w != "")
    some = lambda words_: F.coalesce(words_, F.array().cast("array<string>"))

    def row(x: Column, i: Column) -> Column:
        left = words(some(at(i - 2)["tail"]), own(i - 2), some(at(i - 1)["tail"]), own(i - 1), at(i)["tail"])
        right = words(at(i + 1)["head"], own(i + 1), some(at(i + 2)["head"]), own(i + 2), some(at(i + 3)["head"]))
        last = lambda w: F.slice(F.split(F.array_join(w, " "), _BLANK), F.lit(-CONTEXT), F.lit(CONTEXT))
        first = lambda w: F.slice(F.split(F.array_join(w, " "), _BLANK), F.lit(1), F.lit(CONTEXT))
        whole = lambda w: F.when(F.size(w) == CONTEXT, F.lower(F.array_join(w, " ")))
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), at(i)["gap"].alias("gap"), F.length(x).alias("size"), x.alias("found"), whole(last(left)).alias("left"), whole(first(right)).alias("right"))

    return F.coalesce(F.transform(found, row), F.array().cast(_HITS))


def scanned(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs``, written, with a row number ``__row`` and the raw matches ``__hits`` of every whole text; null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__row", F.monotonically_increasing_id())
    patterns = [(rank, kind, PATTERNS[kind]) for rank, kind in enumerate(KINDS)] + [(WORD, WORD, MARK), (SEVERAL, SEVERAL, RUN)]
    out = out.withColumns({f"__parts{rank}": _parted(text, kind, pattern) for rank, kind, pattern in patterns})
    for rank in (WORD, SEVERAL):
        parts = F.col(f"__parts{rank}")
        some = F.size(parts) > 1
        own = F.filter(parts, lambda x, i: i % 2 == 1)
        gaps = F.transform(F.filter(parts, lambda x, i: i % 2 == 0), lambda g: _ends(g).withField("gap", F.length(g)))
        out = out.withColumns({f"__found{rank}": F.when(some, own), f"__ends{rank}": F.when(some, gaps)})
    hits = [_hits(F.col(f"__parts{rank}"), rank) for rank in range(len(KINDS))]
    hits += [_beside(F.col(f"__found{rank}"), F.col(f"__ends{rank}"), rank) for rank in (WORD, SEVERAL)]
    out = out.withColumn("__hits", F.concat(*hits)).drop(*[c for c in out.columns if c.startswith(("__parts", "__found", "__ends"))])
    return written(out if keep_text else out.drop(text_col), "pii")


def placed(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, rank, start, end, found) of the base spans, and (row, rank, start, end, found, left, right) of the identifier-like words and runs."""
    each = scan.select(F.col("__row").alias("row"), F.inline("__hits"))
    before = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    each = written(each.select("row", "rank", "start", "end", "found", "left", "right"), "spans")
    sound = reduce(lambda a, b: a | b, [(F.col("rank") == rank) & _sound(kind, F.col("found")) for rank, kind in enumerate(KINDS)])
    return each.where(sound).drop("left", "right"), each.where(F.col("rank") >= WORD)


def _core(found: Column) -> tuple[Column, Column]:
    """An identifier-like word without the marks around it, and how many came before it."""
    before = r"^(?:[^\p{L}0-9+(]|\((?![0-9]++\)))*+"
    head = F.length(F.regexp_extract(found, before, 0))
    return F.regexp_replace(found, before + r"|[^\p{L}0-9]*$", ""), head


def _class(found: Column) -> Column:
    """The coarse class of what may be an identifier: an address, a number of some length, or null."""
    digits, letters = (F.length(F.regexp_replace(found, c, "")) for c in ("[^0-9]", "[^A-Za-z]"))
    address = F.contains(found, F.lit("@")) | found.rlike(r"(?i)(?<![a-z])at(?![a-z])")
    return F.when(address, "@").when((digits >= 4) & (digits > letters), "9")


def _shape(found: Column) -> Column:
    """The form of an identifier: a for a run of letters, d for one to three digits, every digit of a longer run as 9, marks as they are."""
    letters = F.regexp_replace(found, r"\p{L}++", "a")
    return F.regexp_replace(F.regexp_replace(letters, r"(?<![0-9])[0-9]{1,3}(?![0-9])", "d"), "[0-9]", "9")


def _marks(found: Column) -> Column:
    """An identifier's marks, in order."""
    return F.regexp_replace(found, r"[\p{L}0-9]++", "")


def _word_class(word: Column) -> Column:
    """The class of the word beside an identifier: what it is made of and ends with; null is the edge of a text."""
    made = lambda pattern: word.rlike(pattern)
    return F.when(word.isNull(), "edge").when(made(r"^\p{L}++$"), "word").when(made("[0-9@]"), "number").when(made(r"\p{L}:$"), "label").when(made(r"\p{L}[,;]$"), "pause").when(made(r"\p{L}[.!?]$"), "stop").otherwise("marks")


def _patterns(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows`` (instance, left, right, ...) for each of their patterns.

    ``left`` and ``right``: two words on that side with the coarse class.  The others are marked ``shape``: the nearest word of a
    side with the form or with the marks, the classes of both nearest words with the marks, and ``bare``, the form alone.
    """
    found = F.col("instance")
    rows = rows.withColumns({"class": _class(found), "form": _shape(found), "marks": _marks(found)}).where("class is not null")
    near = {"left": F.substring_index("left", " ", -1), "right": F.substring_index("right", " ", 1)}
    side = lambda name: F.when(F.col(name).isNotNull(), F.concat_ws("\x01", F.lit(name), F.col(name), F.col("class")))
    word = lambda name, what: F.when(F.col(name).isNotNull(), F.concat_ws("\x01", F.lit(what), F.lit(name), near[name], F.col(what), F.col("class")))
    classes = F.concat_ws("\x01", F.lit("classes"), *map(_word_class, near.values()), F.col("marks"), F.col("class"))
    every = [*[side(n) for n in near], *[word(n, what) for n in near for what in ("form", "marks")], classes, F.concat_ws("\x01", F.lit("bare"), F.col("form"))]
    rows = rows.select(*keep, "instance", F.explode(F.array_compact(F.array(*every))).alias("pattern"))
    return rows.withColumn("shape", ~F.col("pattern").rlike("^(left|right)\x01"))


#: Parts that the rows of one pattern are dealt to where they meet what is known of it.
SALTS = 8


def _met(rows: DataFrame, patterns: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with the few rows of each of ``patterns``; a pattern with most rows is several tasks."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in ("instance", "row", "start") if c in rows.columns]), F.lit(SALTS)).cast("int"))
    copies = patterns.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["pattern", "__salt"], how).drop("__salt")


def scored(edges: DataFrame, known: DataFrame, *, turns: int = TURNS, smooth: float = SMOOTH) -> DataFrame:
    """(pattern, rank, trust) of the bipartite graph ``edges`` (pattern, instance, shape) with scores ``known`` (instance, rank, score).

    A pattern's trust is its instances' sum of scores over their number plus ``smooth``; an instance of unknown score has the mean
    trust of its patterns of two words.  A pattern with a form is as trustworthy as its known instances make it: it neither
    learns from guesses nor gives any, or what merely looks like an identifier would vouch for itself.
    """
    degree = edges.groupBy("pattern").agg(F.count("*").alias("degree"), F.bool_or("shape").alias("shape"))
    scores, trusted = known, None
    for _ in range(turns):
        sums = edges.join(scores, "instance").groupBy("pattern", "rank").agg(F.sum("score").alias("sum"), F.sum(F.col("score") * F.col("sure").cast("int")).alias("seen"))
        trusted = sums.join(degree, "pattern").select("pattern", "rank", "shape", (F.when(F.col("shape"), F.col("seen")).otherwise(F.col("sum")) / (F.col("degree") + smooth)).alias("trust"))
        trusted = written(trusted, "trust")
        guessed = _met(edges.where("not shape"), trusted.drop("shape")).groupBy("instance", "rank").agg(F.avg("trust").alias("guess"))
        scores = guessed.join(known, ["instance", "rank"], "full").select("instance", "rank", F.coalesce("score", "guess").alias("score"), F.coalesce("sure", F.lit(False)).alias("sure"))
    return trusted.drop("shape")


def discovered(base: DataFrame, marks: DataFrame, *, turns: int = TURNS, support: int = SUPPORT, trust: float = TRUST, smooth: float = SMOOTH, bare: bool = True) -> DataFrame:
    """(row, rank, start, end, contextual) of the identifiers that trusted patterns extract and no base span touches.

    ``contextual`` are those that a pattern with a context extracts, for whatever kind; the others have a trusted form and no
    more.  Without ``bare`` forms alone extract nothing.
    """
    none = F.lit(None).cast("string")
    every = base.select("row", "start", "end", "rank", "found", none.alias("left"), none.alias("right")).unionByName(marks.select("row", "start", "end", "rank", "found", "left", "right"))
    order = Window.partitionBy("row").orderBy("start", F.desc("rank"), "end")
    # the rows after a row are those before it in the opposite order: a frame to the end of the text is read anew for each row
    back = Window.partitionBy("row").orderBy(F.desc("start"), "rank", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    is_base, is_word = F.col("rank") < WORD, F.col("rank") == WORD
    every = every.withColumns({
        "over": F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.last(F.when(is_base, F.col("start")), ignorenulls=True).over(back),
        "mark": F.last(F.when(is_word, F.struct("end", "left")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    every = every.withColumn("free", ~is_base & (F.coalesce("over", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    # words of a free run are parts of it
    every = every.withColumn("run_end", F.max(F.when(F.col("free") & ~is_word, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = Window.partitionBy("row").orderBy(F.desc("end"), F.desc("rank"), F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("last", F.last(F.when(is_word, F.struct("start", "right")), ignorenulls=True).over(ends))
    every = written(every, "marks")
    core, head = _core(F.col("found"))
    side = lambda sound, name: F.when(sound, F.col(name))
    seeds = every.where(is_base).select(F.col("found").alias("instance"), "rank", side(F.col("mark.end") > F.col("start"), "mark.left").alias("left"), side(F.col("last.start") < F.col("end"), "last.right").alias("right"))
    seeds = _patterns(seeds, "rank")
    free = every.where(F.col("free") & (~is_word | (F.coalesce("run_end", F.lit(0)) <= F.col("start"))))
    free = free.select("row", (F.col("start") + head).alias("start"), core.alias("instance"), "left", "right")
    free = _patterns(free.withColumn("end", F.col("start") + F.length("instance")), "row", "start", "end")
    if not bare:
        seeds = seeds.where(~F.startswith("pattern", F.lit("bare\x01")))
    seeds = written(seeds.groupBy("pattern", "instance", "rank", "shape").agg(F.lit(1.0).alias("score")), "seeds")
    known = seeds.groupBy("instance", "rank").agg(F.max("score").alias("score")).withColumn("sure", F.lit(True))
    induced = seeds.groupBy("pattern").agg(F.countDistinct("instance").alias("seeds"))
    free = _met(free, induced.select("pattern"), "left_semi")
    edges = written(free.select("pattern", "instance", "shape").unionByName(seeds.select("pattern", "instance", "shape")).distinct(), "edges")
    trusted = scored(edges, known, turns=turns, smooth=smooth)
    best = trusted.join(induced, "pattern").where((F.col("trust") >= trust) & (F.col("seeds") >= support)).groupBy("pattern").agg(F.max_by("rank", F.struct("trust", -F.col("rank"))).alias("rank"))
    found = _met(free.drop("shape"), best.join(trusted, ["pattern", "rank"]))
    context = F.bool_or(~F.startswith("pattern", F.lit("bare\x01")))
    return found.groupBy("row", "start", "end").agg(F.max_by("rank", F.struct("trust", -F.col("rank"))).alias("rank"), context.alias("contextual")).select("row", "rank", "start", "end", "contextual")


def annotate(docs: DataFrame, text_col: str = "text", *, keep_text: bool = True, **options) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: array<struct<rank, start, end>>, kinds in the order of :data:`KINDS`, then starts; and
    ``n_contextual`` and ``n_form``, the numbers of discovered spans that contexts extract and that forms alone do.

    Places are code points, ends exclusive.  ``base`` are the fixed patterns' sound matches; ``spans`` are these and the
    discovered ones.  Null texts are empty; every row stays, repeated ones too; input columns of these names
    are replaced.  Without ``keep_text`` the text is left out of the result.
    """
    scan = scanned(docs.drop("base", "spans", "n_contextual", "n_form"), text_col, keep_text)
    base, marks = placed(scan)
    more = discovered(base, marks, **options)
    every = base.select("row", "rank", "start", "end", F.lit(True).alias("fixed"), F.lit(None).cast("boolean").alias("contextual")).unionByName(more.withColumn("fixed", F.lit(False)))
    span = F.struct("rank", "start", "end")
    arrays = every.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.when(F.col("fixed"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"), F.count_if("contextual").alias("n_contextual"), F.count_if(~F.col("contextual")).alias("n_form"))
    none = F.array().cast("array<struct<rank:int,start:bigint,end:bigint>>")
    out = scan.drop("__hits").join(arrays, "__row", "left").drop("__row")
    return out.withColumns({c: F.coalesce(F.col(c).cast("array<struct<rank:int,start:bigint,end:bigint>>"), none) for c in ("base", "spans")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_contextual", "n_form")})


def of_kind(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.filter(spans, lambda s: s["rank"] == rank)


def written_spans(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced once."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(text.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(names, s["rank"]))
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    done = F.aggregate(ordered, start, step)
    rest = F.aggregate(ordered, F.lit(0).cast("bigint"), lambda a, s: F.greatest(a, s["end"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), text.substr((rest + 1).cast("int"), F.length(text)))).otherwise(text)
