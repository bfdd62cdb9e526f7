"""Personal data in texts: base expressions, and identifiers found by bootstrapped contexts. DataFrame functions only.

Base spans come from four expressions. They are the seeds: the words before a seed make a lexical pattern for its kind.
Patterns and the identifier-like tokens (instances) that follow them form a graph, which is scored in turns: a pattern by the
share of known instances among all that it extracts, an instance by the patterns that extract it; instances that score high
are known in the next turn. Turns go on until none is new. What follows a pattern of high confidence, and looks like its
kind, is added to the spans.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

KINDS = ("email", "ip", "card", "phone")
_NAME, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"

# Possessive loops over single characters: linear on any text, and nothing is stacked for long runs. A name can only begin
# where the run of its characters does, or where the match before it ended. Dots and separators that the plain expressions
# would not take are masked before by a character of equal length that can't be matched at that place.
_EMAIL = rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[{_HOST}]++\.[{_HOST}.]++"
_EMAIL_MASK = rf"(?<![{_HOST}])\.|\.(?![{_HOST}])"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_VALID = rf"^{_IP_PART}\.{_IP_PART}\.{_IP_PART}\.{_IP_PART}$"
_CARD = r"[0-9][0-9 -]++"
_CARD_MASK = r"(?<![0-9])[ -]|[ -](?![0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: what looks like an identifier: a token that holds a digit or an at sign, without the punctuation that closes it
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_LEAST = 5
_CLOSING = r""".,:;!?>"'\]}»”’"""
#: digit groups joined by single spaces, up to 19 digits in whole groups
_GROUPS = rf"^[(+]{{0,2}}[0-9](?:[)/-]{{0,2}} ?\(?[0-9]){{1,18}}(?=[{_CLOSING})]*+(?:\s|\z))"

_BLOCK = 128
#: code points before a match in which its words are looked for, in blocks
_REACH = 32
_FOUND = "array<struct<start: long, end: long, words: string, found: string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once: inside a lambda function Spark computes an expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column, first, count) -> Column:
    return F.aggregate(F.slice(values, first, count), F.lit(0).cast("long"), lambda a, x: a + x)


def _blocks(text: Column) -> Column:
    """The text in blocks of code points, so that what is around a place is read without a walk through the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def _words(blocks: Column, start: Column) -> Column:
    """The two words that end before the start, in lower case; empty if there aren't two."""
    block = F.floor(start / _BLOCK).cast("int")
    own = F.left(F.get(blocks, block), F.pmod(start, F.lit(_BLOCK)).cast("int"))

    def last_two(before: Column) -> Column:
        return F.regexp_extract(F.rtrim(F.regexp_replace(before, r"\s+", " ")), r" ([^ ]++ [^ ]++)$", 1)

    near = last_two(F.concat(F.when(block <= 1, F.lit(" ")).otherwise(F.lit("")), F.coalesce(F.get(blocks, block - 1), F.lit("")), own))
    first = F.greatest(block - _REACH, F.lit(0))
    far = last_two(F.concat(F.lit(" "), F.array_join(F.slice(blocks, first + 1, block - first), ""), own))
    return F.lower(_let(near, lambda found: F.when((found != "") | (block <= 1), found).otherwise(far)))


def _matches(text: Column, expression: str, whole: Column) -> Column:
    """start, end, the words before and the string of each match, leftmost first, in code points of the text.

    The words are those of the whole text, which is the text before characters were masked.
    """
    def placed(z: Column) -> Column:
        def match(m: Column, i: Column) -> Column:
            inside = F.pmod(i, F.lit(_BLOCK))
            start = F.get(z.before, F.floor(i / _BLOCK).cast("int")) + _total(z.z.steps, i - inside + 1, inside) + F.length(F.get(z.z.parts, i))
            return _let(start, lambda at: F.struct(
                at.alias("start"), (at + F.length(m)).alias("end"), _words(z.z.blocks, at).alias("words"), m.alias("found")))

        return F.transform(z.z.found, match)

    def summed(z: Column) -> Column:
        # sums before each block of matches, so that the work for a match stays bounded
        numbers = F.sequence(F.lit(0), F.floor(F.size(z.found) / _BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: _total(z.steps, b * _BLOCK + 1, F.lit(_BLOCK)))
        before = _let(blocks, lambda v: F.transform(v, lambda _, b: _total(v, F.lit(1), b)))
        return _let(F.struct(z.alias("z"), before.alias("before")), placed)

    def stepped(z: Column) -> Column:
        steps = F.transform(z.found, lambda m, i: (F.length(F.get(z.parts, i)) + F.length(m)).cast("long"))
        blocks = F.when(F.size(z.found) > 0, _blocks(whole))
        return _let(F.struct(z.parts.alias("parts"), z.found.alias("found"), steps.alias("steps"), blocks.alias("blocks")), summed)

    parts, found = F.split(text, expression, -1), F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    return _let(F.struct(parts.alias("parts"), found.alias("found")), stepped)


def _unclosed(run: Column) -> Column:
    """The run without closing punctuation; a bracket closes what the run itself opens, and :: may end an address."""
    def without(marks: str) -> Column:
        return F.regexp_replace(run, rf"(?<![{marks}])[{marks}]++\z", "")

    return F.when(run.endswith("::"), run).when(F.contains(run, F.lit("(")), without(_CLOSING)).otherwise(without(_CLOSING + ")"))


def _tokens(whole: Column, seeds: Column) -> Column:
    """Identifier-like tokens that overlap no seed: from each word on, the digit groups joined by spaces, or else the word."""
    def free(t: Column) -> Column:
        return ~F.exists(seeds, lambda s: (s.start < t.end) & (t.start < s.end))

    def token(t: Column, found: Column) -> Column:
        return F.struct(t.start.alias("start"), (t.start + F.length(found)).alias("end"), t.words.alias("words"), found.alias("found"))

    def of_word(t: Column, blocks: Column) -> Column:
        block = F.floor(t.start / _BLOCK).cast("int")
        ahead = F.substr(F.array_join(F.slice(blocks, block + 1, F.lit(3)), ""), F.pmod(t.start, F.lit(_BLOCK)).cast("int") + 1)
        groups = F.when(t.found.rlike("^[(+]{0,2}[0-9][0-9()/-]*+$"), F.regexp_extract(ahead, _GROUPS, 0)).otherwise(F.lit(""))
        word = token(t, _unclosed(t.found))
        return _let(groups, lambda g: F.when(F.contains(g, F.lit(" ")), _let(
            token(t, g), lambda joined: F.when(free(joined), joined).otherwise(word))).otherwise(word))

    found = _let(_matches(whole, _TOKEN, whole), lambda z: F.when(F.size(z) > 0, _let(
        _blocks(whole), lambda blocks: F.transform(z, lambda t: of_word(t, blocks)))).otherwise(F.array().cast(_FOUND)))
    return _where_any(whole.rlike("[0-9@]"), F.filter(found, lambda t: (F.length(t.found) >= _LEAST) & free(t)))


def _apart(added: Column) -> Column:
    """Of spans, sorted by their starts, that overlap, the ones that start first."""
    def step(kept: Column, s: Column) -> Column:
        more = F.struct(F.concat(kept.spans, F.array(s)).alias("spans"), s.start.alias("start"), s.end.alias("end"))
        return F.when((s.start >= kept.end) | (s.start == kept.start), more).otherwise(kept)

    none = F.struct(
        F.slice(added, 1, 0).alias("spans"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    overlap = F.exists(F.transform(added, lambda s, i: F.get(added, i + 1).start < s.end), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(overlap, F.aggregate(added, none, step, lambda kept: kept.spans)).otherwise(added)


def _where_any(condition: Column, matches: Column) -> Column:
    """Most texts hold nothing of a kind; a cheap test spares them the rest."""
    return F.when(condition, matches).otherwise(F.array().cast(_FOUND))


def base_matches(text: Column) -> dict[str, Column]:
    """Valid base matches by kind; matches that fail a check are dropped, and nothing else is tried in their place."""
    email = _where_any(F.contains(text, F.lit("@")), _matches(F.regexp_replace(text, _EMAIL_MASK, "%"), _EMAIL, text))
    ip = _where_any(text.rlike(r"[0-9]\.[0-9]"), _matches(text, _IP, text))
    card = _where_any(text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), _matches(F.regexp_replace(text, _CARD_MASK, "_"), _CARD, text))
    phone = _where_any(F.contains(text, F.lit("+")), _matches(text, _PHONE, text))
    # masked dots in the string of a name are put right
    email = F.transform(email, lambda m: F.struct(
        m.start.alias("start"), m.end.alias("end"), m.words.alias("words"),
        F.substring(text, (m.start + 1).cast("int"), (m.end - m.start).cast("int")).alias("found")))
    return {
        "email": email,
        "ip": F.filter(ip, lambda m: m.found.rlike(_IP_VALID)),
        "card": F.filter(card, lambda m: F.length(_digits(m.found)).between(16, 19) & F.call_function("luhn_check", _digits(m.found))),
        "phone": F.filter(phone, lambda m: F.length(_digits(m.found)).between(8, 15)),
    }


def _named(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(
        F.lit(kind).alias("kind"), m.start.alias("start"), m.end.alias("end"), m.words.alias("words"), m.found.alias("found")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s.kind == kind)


def _looks_like(kind: Column, token: Column) -> Column:
    """Whether an identifier-like token could be of the kind."""
    digits = F.length(_digits(token))
    return (
        F.when(kind == "email", token.rlike(r"^[^@]+@[^@]+$"))
        .when(kind == "ip", token.rlike(r"^[0-9]++[.:][0-9.:]++$") | token.rlike(r"^[0-9a-fA-F]++:[0-9a-fA-F:]*+:[0-9a-fA-F:]*+$"))
        .when(kind == "card", digits >= 12)
        .when(kind == "phone", (digits >= 7) & token.rlike(r"^[0-9().+/ -]++$"))
        .otherwise(False)
    )


def _patterns(rows: DataFrame, turns: int | None, confidence: float, support: int) -> DataFrame:
    """(words, kind) of the patterns whose confidence reaches the bound."""
    # a long token travels as its hash
    instance = F.when(F.length("m.found") > 64, F.sha2(F.lower("m.found"), 256)).otherwise(F.lower("m.found")).alias("instance")
    seeds = rows.select(F.explode("seeds").alias("m")).select("m.words", "m.kind", instance)
    tokens = rows.select(F.explode("tokens").alias("m")).select("m.words", F.lit(None).cast("string").alias("kind"), instance)
    # the graph: each edge once, with how often it occurs
    edges = written(
        seeds.union(tokens).where("words <> ''").groupBy("words", "instance", "kind").agg(F.count("*").alias("n")), "pattern-graph")
    pairs = edges.groupBy("words", "instance").agg(F.sum("n").alias("n"))
    known = written(edges.where("kind is not null").select("instance", "kind").distinct(), "known-instances")
    count, turn = known.count(), 0
    while True:
        turn += 1
        # only words that stand before `support` known instances, seeds or discovered ones, can be a pattern in this turn
        lead = written(
            pairs.join(known, "instance").groupBy("words", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
            .where(F.col("k") >= support), "leads")
        every = edges.join(lead.select("words").distinct(), "words", "left_semi").groupBy("words").agg(F.sum("n").alias("every"))
        scored = lead.join(every, "words").withColumn("score", F.col("n") / (F.col("every") + 1))
        patterns = written(scored.where(F.col("score") >= confidence).select("words", "kind", "score"), "patterns")
        # an instance is right unless all patterns that extract it are wrong
        reached = pairs.select("words", "instance").join(patterns, "words").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
        known = written(known.union(reached.where(F.col("score") >= confidence).select("instance", "kind")).distinct(), "known-instances")
        before, count = count, known.count()
        # known instances are never forgotten, so the turns end
        if count == before:
            break
        if turn == turns:
            warnings.warn(f"personal_data stopped after {turns} turns, the last of which found {count - before} new instances")
            break
    return patterns.select("words", "kind")


def personal_data(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", turns: int | None = None, confidence: float = 0.7, support: int = 5,
) -> DataFrame:
    """doc_id, base and spans of every row; both are arrays of (kind, start, end, found) in the order of kinds, then starts.

    Positions are code points of the whole text, ends exclusive. `spans` holds the base ones and those that patterns with at
    least `support` known instances and the given `confidence` discover; the latter overlap no base span. A pattern is the two
    words before an identifier, as far as they lie within 4,096 code points. Tokens have at least five code points. Patterns and
    instances are scored until no instance is new; `turns` ends this earlier, with a warning if some still were. A null or empty text has no spans; every row gives a row, repeated and null ids included.
    Other columns aren't read. An empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = base_matches(whole)
    seeds = F.concat(*(_named(kept[k], k) for k in KINDS))
    both = _let(seeds, lambda z: F.struct(z.alias("seeds"), _tokens(whole, z).alias("tokens")))
    rows = written(
        documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), both.alias("found"))
        .select("row", "doc_id", "found.seeds", "found.tokens"), "mentions",
    )
    patterns = _patterns(rows, turns, confidence, support)
    extracted = rows.select("row", F.explode("tokens").alias("m")).select("row", "m.*").join(patterns, "words")
    extracted = extracted.where(_looks_like(F.col("kind"), F.col("found")))
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "kind", "found")))
    added = extracted.groupBy("row").agg(spans.alias("added")).select("row", F.transform(
        _let(F.col("added"), _apart), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.found.alias("found"))).alias("added"))
    base = F.transform("seeds", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.found.alias("found")))
    joined = rows.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    both = F.concat("base", "added")
    ordered = F.concat(*(F.array_sort(of_kind(both, k)) for k in KINDS))
    return joined.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(ordered).alias("spans"))


def joined_spans(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
