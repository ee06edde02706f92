"""PII in DataFrame functions: patterned identifiers, random secrets, and terms that reveal them by corpus co-occurrence.

The last part is information-theoretic sanitisation. Protected entities are the identifiers that recur (their values
without case and separators) and the kinds of identifiers. A term stands by an entity where it lies within a window of
characters around it, lines notwithstanding. Over all documents a term discloses an entity by p = P(entity by it | term), at
a gain of log2(p / P(entity)) bits over knowing nothing. A term beyond both thresholds is removed, one beyond the lower p
generalised to its category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravela.plans.lineage import broadcast_below, cut

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: The kinds that patterns alone decide.
BASE = KINDS[:4]
#: Stands for a separator between two digits, or a dot between two labels, so that a run of them is one class.
_JOIN = "\u0001"
BROADCAST_ROWS = 100_000

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string,instead:string>>"
#: A character of words and of identifiers.
_UNBROKEN = r"[\p{L}\p{N}._%+@/-]"
#: An unbroken run that may be a secret, and the fewest bits a character that it must have.
_RUN, SECRET_BITS = r"(?<![A-Za-z0-9_+])[A-Za-z0-9_+]{20,}+", 3.0


def matches(text: Column, pattern: str | Column, value_of: Column | None = None) -> Column:
    """All matches, as array<struct<start, end, value>> in code points; value_of: the text that values are cut from, of equal length."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, pair):
        first = acc["at"] + F.length(pair["between"])
        last = first + F.length(pair["found"])
        value = pair["found"] if value_of is None else F.substring(value_of, first + 1, last - first)
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"), value.alias("value")))).alias("out"))

    pairs = F.arrays_zip(found.alias("found"), F.slice(between, 1, F.size(found)).alias("between"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    back = F.reverse(digits)

    def step(total, i):
        x = F.substring(back, i, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


#: What a text must hold for a kind to be looked for.
_GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": "[0-9]" + r"[\x20-]?[0-9]" * 11, "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_+]{20}"}


def may_hold(text: Column) -> Column:
    """False for most texts without an identifier, at the cost of a look."""
    out = F.lit(False)
    for pattern in _GUARDS.values():
        out = out | text.rlike(pattern)
    return out


def entropy(value: Column) -> Column:
    """Shannon bits a character of a non-empty string."""
    n = F.length(value)
    counts = F.transform(F.array_distinct(F.split(value, "")), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    return F.aggregate(counts, F.lit(0.0), lambda total, k: total - k / n * F.log2(k / n))


def _is_secret(run: Column) -> Column:
    """Random letters and digits: digits follow letters three times or more, and no character is foreseen."""
    return (F.regexp_count(run, F.lit("(?<=[A-Za-z])[0-9]")) >= 3) & (entropy(run) >= SECRET_BITS)


def base_spans(text: Column, extra: Column | None = None) -> Column:
    """Emails, IPv4 addresses, card and phone numbers and secrets of a non-null text, in order of start and kind.

    extra: more spans, listed among them. Matches are leftmost and don't overlap within a kind; one that fails its check is dropped without another try.
    The patterns are written without repeated groups, so that no long run of matches can exhaust the stack.
    """
    plain = F.translate(text, _JOIN, "\u0002")
    joined = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOIN)
    local = r"[A-Za-z0-9._%+\x01-]"
    email = matches(joined, rf"(?:(?<!{local})|\G){local}++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++", text)
    part = r"\.[0-9]++"
    ip = F.filter(matches(text, rf"(?<![0-9])[0-9]++{part}{part}{part}"), lambda m: F.forall(F.split(m["value"], r"\."), lambda p: _octet(p)))
    chained = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN)
    card = F.filter(matches(chained, r"(?<![0-9\x01])[0-9][0-9\x01]{11,}+", text), lambda m: F.length(_digits(m["value"])).between(12, 19) & luhn(_digits(m["value"])))
    phone = F.filter(matches(text, r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: F.length(_digits(m["value"])).between(9, 15))
    none = F.array().cast(_SPANS)
    secret = F.filter(matches(text, _RUN), lambda m: _is_secret(m["value"]))
    found = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    listed = [F.when(text.rlike(_GUARDS[kind]), F.transform(x, _named(kind, rank))).otherwise(none) for rank, (kind, x) in enumerate(found.items())]
    if extra is not None:
        listed.append(F.coalesce(extra, none))
    return F.array_sort(F.concat(*listed))


def _named(kind: str, rank: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), F.lit(f"[{kind.upper()}]").alias("instead"))


def _octet(part: Column) -> Column:
    number = F.regexp_replace(part, "^0+", "")
    return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))


def _terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def _entity(span: Column) -> Column:
    """kind:value, the value without case and, in numbers, without separators."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).when(span["kind"] == "secret", span["value"]).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _contexts(docs: DataFrame, window: int) -> DataFrame:
    """(doc, entity, near): a row for each entity and mention, near the whole words around it without identifiers."""
    held = docs.where(may_hold(F.col("text"))).select(F.monotonically_increasing_id().alias("doc"), "text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text")))
    spots = F.transform("spans", lambda s, i: F.struct(s.alias("s"), F.greatest(F.get(ends, i), s["start"] - window).alias("low"), F.least(F.get(starts, i + 1), s["end"] + window).alias("high")))
    at = held.select("doc", "text", F.explode(spots).alias("x")).select("doc", "text", "x.s", "x.low", "x.high")

    def piece(a, b):
        """The text between two places, without what touches them unbroken: it may be cut, or belong to an identifier."""
        found = F.substring("text", a + 1, F.greatest(F.lit(0), b - a))
        found = F.when(a > 0, F.regexp_replace(found, rf"\A{_UNBROKEN}++", "")).otherwise(found)
        return F.when(b < F.length("text"), F.regexp_replace(found, rf"(?<!{_UNBROKEN}){_UNBROKEN}++\z", "")).otherwise(found)

    near = F.concat_ws(" ", piece(F.col("low"), F.col("s.start")), piece(F.col("s.end"), F.col("high")))
    return at.select("doc", F.explode(F.array(_entity(F.col("s")), F.col("s.kind"))).alias("entity"), near.alias("near"))


def _surely(k: Column, n: Column, z: float = 2.576) -> Column:
    """The share that k of n makes likely at least (Wilson's lower bound of 99 %)."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(F.greatest(p * (1 - p) / n + z * z / (4 * n * n), F.lit(0.0)))) / (1 + z * z / n)


def disclosing_terms(docs: DataFrame, support: int = 3, least_p: float = 0.5, remove_p: float = 0.8, bits: float = 2.0, window: int = 100) -> DataFrame:
    """(term, entity, p, gain_bits, action) over all of docs(text): each term that reveals an entity, with the one that gains most.

    A term stands by an entity in a document if it lies within `window` characters of a mention, other
    identifiers ending the window. p is the share of the documents with the term in which it does, copies included. Its
    lower 99 % bound must reach least_p, as a large vocabulary meets anything a few times, and it
    needs `support` different windows, so that copied documents are no evidence. An entity in more than 2**-bits
    of all documents can't be gained and is left out. action is "remove" from remove_p on, else "generalise". Counts are
    exact and cover all documents; no list of a term's or an entity's documents is ever gathered.
    """
    none = docs.sparkSession.createDataFrame([], "term string, entity string, p double, gain_bits double, action string")
    contexts = cut(_contexts(docs, window))
    if not contexts.limit(1).count():
        return none
    total = docs.count()
    entities = contexts.groupBy("entity").agg(F.count_distinct("near").alias("n_near"), F.count_distinct("doc").alias("n_entity"))
    entities = cut(entities.where((F.col("n_near") >= support) & (F.col("n_entity") <= total * 2.0**-bits)).select("entity", "n_entity"))
    by = contexts.join(broadcast_below(entities.select("entity"), BROADCAST_ROWS), "entity", "left_semi")
    by = by.select("entity", "doc", F.xxhash64("near").alias("near"), F.explode(_terms(F.col("near"))).alias("term"))
    both = by.groupBy("entity", "term").agg(F.count_distinct("doc").alias("n_both"), F.count_distinct("near").alias("n_near")).where(F.col("n_near") >= support)
    both = cut(both.select("entity", "term", "n_both").join(entities, "entity"))

    def passing(counts: DataFrame) -> DataFrame:
        p = F.col("n_both") / F.col("n_term")
        scored = both.join(counts, "term").withColumns({"p": p, "gain_bits": F.log2(p * total / F.col("n_entity"))})
        return scored.where((_surely(F.col("n_both"), F.col("n_term")) >= least_p) & (F.col("gain_bits") >= bits))

    # The documents with identifiers bound a term's count from below: most terms can't reach p any more.
    held = docs.where(may_hold(F.col("text"))).select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    wanted = cut(passing(held).select("term").distinct())
    if not wanted.limit(1).count():
        return none
    every = docs.select(F.explode(_terms(F.col("text"))).alias("term")).join(broadcast_below(wanted, BROADCAST_ROWS), "term", "left_semi")
    scored = passing(every.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")))
    best = scored.groupBy("term").agg(F.max(F.struct("gain_bits", "p", "entity")).alias("best")).select("term", "best.*")
    return cut(best.select("term", "entity", "p", "gain_bits", F.when(F.col("p") >= remove_p, "remove").otherwise("generalise").alias("action")))


def _category(term: Column) -> Column:
    """What a generalised term becomes: a number, a word, or a code of letters and digits."""
    return F.when(~term.rlike(r"\p{L}"), "[NUMBER]").when(~term.rlike(r"\p{N}"), "[WORD]").otherwise("[CODE]")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """(doc_id, text, spans), one row for each input row; spans as base_spans, with kind term for disclosing terms.

    A span's `instead` is what sanitise puts in its place. A null text counts as empty. Equal rows give equal
    results; ids may have any type, be null or repeat; other columns are ignored. Offsets are code points, the end exclusive.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = disclosing_terms(docs, **thresholds).select("term", F.when(F.col("action") == "remove", "[TERM]").otherwise(_category(F.col("term"))).alias("instead"))
    if not terms.limit(1).count():
        return docs.select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    held = docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(_terms(F.col("text"))).alias("term"))
    held = held.join(broadcast_below(terms, BROADCAST_ROWS), "term").groupBy("doc_id", "key").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", "instead")))).alias("terms"))
    held = cut(held.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "terms"))
    if (held.agg(F.sum(F.size("terms"))).first()[0] or 0) <= BROADCAST_ROWS:
        held = F.broadcast(held)
    joined = docs.join(held, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key")), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys("terms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    named = _named("term", KINDS.index("term"))
    instead = lambda m: F.coalesce(F.element_at("terms", F.lower(m["value"])), F.lit("[TERM]"))
    extra = F.transform(matches(F.col("text"), pattern), lambda m: named(m).withField("instead", instead(m)))
    return joined.select("doc_id", "text", base_spans(F.col("text"), F.when(F.col("terms").isNotNull(), extra)).alias("spans"))


def _sanitised() -> Column:
    """The text with each span's `instead` in its place; of overlapping spans the first counts."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        pieces = F.array(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), s["instead"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], pieces).alias("out")))

    return F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"] + 1, F.length("text"))))


def sanitise(found: DataFrame) -> DataFrame:
    """(doc_id, sanitised): identifiers become [KIND], terms removed [TERM], terms generalised [WORD], [NUMBER] or [CODE]."""
    return found.select("doc_id", _sanitised().alias("sanitised"))


def summarise(found: DataFrame) -> DataFrame:
    """Per document the counts of each base kind, a digest of the base spans, all spans as text, and what sanitising does.

    n_private counts the identifiers and secrets, n_removed and n_generalised the terms, n_sanitised the characters of the sanitised text.
    """

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(name, test):
        return F.size(F.filter("spans", test)).cast("long").alias(name)

    def is_kind(kind):
        return lambda s: s["kind"] == kind

    of_kind = [count(f"n_{k}", is_kind(k)) for k in BASE]
    term = lambda s: s["kind"] == "term"
    more = [
        count("n_secret", is_kind("secret")), count("n_private", lambda s: ~term(s)), count("n_removed", lambda s: term(s) & (s["instead"] == "[TERM]")),
        count("n_generalised", lambda s: term(s) & (s["instead"] != "[TERM]")), F.length(_sanitised()).cast("long").alias("n_sanitised"),
    ]
    return found.select("doc_id", *of_kind, F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *more)
