"""Personal data by weak supervision, in DataFrame expressions alone.

Four kinds have fixed rules and always stand (the *base*): e-mail addresses, IPv4 addresses, card
numbers and international phone numbers.  Further candidates, of kinds ``name``, ``ssn``, ``iban``,
``local`` (phone numbers without country code) and ``secret`` (keys and tokens), come from wider patterns.  On every candidate,
base or not, three labelers vote yes, no or not at all: a *regex* labeler on its inner
form, a *gazetteer* labeler (given names, IBAN countries, mail domains, phone exchanges, prefixes of keys), and
a *context* labeler on the words before it.

Expectation-maximisation over the counts of vote patterns estimates, for each kind, how reliable each labeler is and
how many candidates are real.  The expected labels then train the final span
classifier, a naive Bayes model for each kind over the votes, the candidate's length, edge, shape and first
word, and the word before it, the last three by hash.  A further candidate is kept if that model gives it ``KEEP`` or more.

Candidates are found in one pass and stored; both fits read that table.  Vote patterns number 243 at most and
features a few thousand, whatever the input; EM runs as a SQL aggregation over the array of the patterns' counts,
and what comes back to the driver is these tables.  The weights are applied as a literal array: no shuffle.

Positions: a marker from the private use area is put around each match, the text is split
there, and sums of the lengths of the parts give the positions in code points, block by block, so that work stays
near linear in the number of matches.  Possessive
quantifiers and a look-behind keep every pattern linear in the text's length, and leave
the leftmost non-overlapping matches of the plain patterns unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from .shared import fresh, materialise

_MARK, _OTHER = "\ue000", "\ue001"
BASE = ("email", "ip", "card", "phone")
FURTHER = ("name", "ssn", "iban", "local", "secret")
KINDS = BASE + FURTHER
KEEP = 0.5
ROUNDS = 25

_LOCAL_PART = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL_PART}]))[{_LOCAL_PART}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9](?:[ -]?[0-9]){13})[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "name": r"(?<![\p{L}\p{N}])(?:\p{Lu}[\p{Ll}]{1,20}+ ){1,2}\p{Lu}[\p{Ll}]{1,20}+(?![\p{L}\p{N}])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "local": r"(?<![0-9+(.-])(?<![0-9)][ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+",
}
#: Cheap tests without which a kind's pattern isn't tried.
_NEEDS = {"email": "@", "phone": "+", "ssn": "-"}

GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Anna Peter Paul Hans Klaus Wolfgang Ursula Sabine Jean Pierre Marie Claire Sophie Luc Carlos Juan Jose Luis Carmen Maria Pilar Ana "
    "Alice Bob Emma Liam Olivia Noah"
).split()
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split()
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk- sk_ pk_ rk_ xoxa- xoxb- xoxp- xoxr- AIza ya29 eyJ npm_ hf_ SG".split()
_CONTEXT = {
    "email": r"e-?mail|mail|contact|correo|courriel",
    "ip": r"\bip\b|address|adresse|host|server",
    "card": r"card|visa|carte|karte|tarjeta",
    "phone": r"phone|tel|call|fax|mobil|appel|llam",
    "name": r"\bmr\b|\bmrs\b|\bms\b|\bdr\b|name|herr|frau|monsieur|madame|señor|señora|nombre|nom",
    "ssn": r"ssn|social security|security",
    "iban": r"iban|konto|account|compte|cuenta",
    "local": r"phone|tel|call|fax|mobil|appel|llam",
    "secret": r"token|secret|key|passw|pwd|auth|bearer|credential|clave|clé|schlüssel",
}
_NEAR = 24
_BLOCK = 64  # parts of a text whose lengths are summed anew for each match
_BEFORE = 12  # parts before a match that hold the characters before it: every second one is a match of five or more


_FOUND = "array<struct<start:int,`end`:int,text:string,before:string>>"
_LENGTH = "aggregate(slice(parts, b * {block} + 1, {count}), 0, (n, p) -> n + length(p))"
#: The text is cut at each match: parts at odd places, counted from 0, are matches.  A block's place is a running sum, and
#: within a block the lengths before a match are summed.  ``transform(array(x), name -> ...)[0]`` names a value.
_MATCHES = """
CASE WHEN {guard} THEN
  transform(array(split(regexp_replace({text}, r'(?:{pattern})', '{mark}$0{mark}'), '{mark}')), parts ->
    transform(array(aggregate(
        transform(sequence(0, CAST(floor((size(parts) - 1) / {block}) AS INT)), b -> {whole}),
        named_struct('at', 0, 'seen', CAST(array() AS array<int>)),
        (s, n) -> named_struct('at', s.at + n, 'seen', array_append(s.seen, s.at)), s -> s.seen)), places ->
      flatten(transform(places, (base, b) ->
        CASE WHEN size(parts) - b * {block} < 2 THEN CAST(array() AS {found}) ELSE
          transform(sequence(2, greatest(2, least(size(parts) - b * {block}, {block})), 2), i ->
            transform(array(base + {before}), at -> named_struct(
              'start', at, 'end', at + length(element_at(parts, b * {block} + i)), 'text', element_at(parts, b * {block} + i),
              'before', right(array_join(transform(
                 slice(parts, greatest(b * {block} + i - {parts_before}, 1), least(b * {block} + i - 1, {parts_before})),
                 q -> right(q, {near})), ''), {near})))[0]) END)))[0])[0]
ELSE CAST(array() AS {found}) END
"""


def _matches(text: str, kind: str) -> Column:
    """array<struct<start,end,text,before>> of the leftmost non-overlapping matches of a kind's pattern in column ``text``."""
    text = f"`{text}`"
    pattern = PATTERNS[kind]
    guard = f"contains({text}, '{_NEEDS[kind]}')" if kind in _NEEDS else f"{text} rlike r'{pattern}'"
    whole, before = _LENGTH.format(block=_BLOCK, count=_BLOCK), _LENGTH.format(block=_BLOCK, count="i - 1")
    return F.expr(_MATCHES.format(guard=guard, text=text, pattern=pattern, mark=_MARK, block=_BLOCK, whole=whole, before=before, found=_FOUND, parts_before=_BEFORE, near=_NEAR))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    turned = F.split(F.reverse(digits), "")
    worth = F.transform(turned, lambda d, i: F.when(d == "", 0).otherwise(F.try_to_number(d, F.lit("9")).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)))
    return F.aggregate(worth, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    """The base rules' tests; further kinds have none."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: _small(part) <= 255)
    if kind == "card":
        digits = _digits(text)
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    return F.lit(True)


def _small(part: Column) -> Column:
    """A number of at most three digits after its leading zeros; 999 for longer ones."""
    bare = F.ltrim(part, F.lit("0"))
    return F.when(F.length(bare) == 0, 0).when(F.length(bare) > 3, 999).otherwise(bare.try_cast("int"))


def _votes(kind: str, text: Column, before: Column) -> tuple[Column, Column, Column]:
    """Votes of the regex, gazetteer and context labelers: 1 yes, -1 no, 0 none."""
    digits = _digits(text)
    one, none, no = F.lit(1), F.lit(0), F.lit(-1)
    if kind == "email":
        form = F.when(text.rlike(r"\.[A-Za-z]{2,10}$"), one).otherwise(no)
        known = F.when(text.rlike(r"(?i)\.(com|org|net|edu|gov|de|fr|es|uk|info|io)$"), one).otherwise(none)
    elif kind == "ip":
        form = F.when(text.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), one).otherwise(no)
        known = F.when(text.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), none).otherwise(one)
    elif kind == "card":
        form = F.when(text.rlike(r"^[0-9]{14,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$"), one).otherwise(no)
        known = F.when(digits.rlike("^(?:4|5[1-5]|3[47]|6)"), one).otherwise(no)
    elif kind in ("phone", "local"):
        form = F.when(text.rlike(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), one).otherwise(none)
        known = F.when(digits.rlike("555[0-9]{4}$"), one).when(digits.rlike("^0{3}|0{6}"), no).otherwise(none)
    elif kind == "ssn":
        form = F.when(text.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), one).otherwise(no)
        known = none
    elif kind == "iban":
        form = F.when(F.length(F.replace(text, F.lit(" "), F.lit(""))).between(15, 34), one).otherwise(no)
        known = F.when(F.left(text, F.lit(2)).isin(IBAN_COUNTRIES), one).otherwise(no)
    elif kind == "secret":
        form = F.when(text.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$|^(?=.*[a-z])(?=.*[A-Z])(?!.*[/_-]{2})[A-Za-z0-9+/_=-]{20,}$"), one).otherwise(no)
        known = F.when(text.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"), one).otherwise(none)
    else:
        form = F.when(F.size(F.split(text, " ")) == 2, one).otherwise(none)
        known = F.when(F.split(text, " ")[0].isin(GIVEN_NAMES), one).otherwise(no)
    # Words before a base candidate only speak for it; a further candidate that nothing announces is doubtful.
    near = F.when(before.rlike(f"(?iu)(?:{_CONTEXT[kind]})"), one).otherwise(none if kind in BASE else no)
    return form.cast("int"), known.cast("int"), near.cast("int")


#: Features of the final classifier, and how many values each has.
_FEATURES = {"form": 3, "known": 3, "near": 3, "length": 8, "edge": 3, "shape": 64, "first": 256, "word": 256}
_LABELERS = ("form", "known", "near")


def _bucket(value: Column, feature: str) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(_FEATURES[feature])).cast("int")


def _judged(text: str, k: int, kind: str) -> Column:
    """The valid matches of one kind, with their votes and features in place of their text; votes are 0 for no, 1 for none, 2 for yes."""

    def judged(m: Column) -> Column:
        form, known, near = _votes(kind, m.text, m.before)
        length = F.least(F.floor((m.end - m.start) / 6), F.lit(_FEATURES["length"] - 1)).cast("int")
        edge = F.when(m.before == "", 0).when(m.before.rlike(r"\s$"), 1).otherwise(2).cast("int")
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m.text, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "0")
        word = F.lower(F.regexp_extract(m.before, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))
        first = F.lower(F.regexp_extract(m.text, r"[\p{L}\p{N}]+", 0))
        features = {"form": form + 1, "known": known + 1, "near": near + 1, "length": length, "edge": edge, "shape": _bucket(shape, "shape"), "first": _bucket(first, "first"), "word": _bucket(word, "word")}
        return F.struct(m.start.alias("start"), F.lit(k).alias("kind"), m.end.alias("end"), *(c.alias(n) for n, c in features.items()))

    return F.transform(F.filter(_matches(text, kind), lambda m: _valid(kind, m.text)), judged)


def candidates(docs: DataFrame, column: str = "found") -> DataFrame:
    """``docs`` with ``column``: all candidates, valid base matches included, with their votes and features."""
    plain = fresh(docs, "plain")
    lists = [_judged(plain, k, kind) for k, kind in enumerate(KINDS)]
    marked = docs.withColumn(plain, F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, _OTHER))
    return marked.withColumn(column, F.concat(*lists)).drop(plain)


@dataclass(frozen=True)
class SpanModel:
    """Log-odds of the final classifier: a bias for each kind, and a weight for each (kind, feature, value)."""

    bias: dict
    weights: dict
    reliability: dict  # (kind, labeler) -> (P(yes | real), P(yes | not))


#: EM over the array ``p`` of (kind, votes, n), as one SQL aggregation: the state holds, for each kind and
#: labeler, the probability of its yes among its votes given real and given not, and the share
#: of real candidates of each kind.  Counts are smoothed towards the start, by ten votes.
_FIT = """
aggregate(
  sequence(1, {rounds}),
  named_struct(
    't', transform(sequence(0, 3 * {last} + 2), j -> 0.8D), 'f', transform(sequence(0, 3 * {last} + 2), j -> 0.2D),
    'share', transform(sequence(0, {last}), k -> 0.5D)),
  (s, i) -> aggregate(
    array(transform(p, x -> struct(x, {posterior} as r))), s,
    (old, q) -> named_struct(
      't', transform(sequence(0, 3 * {last} + 2), j -> (8 + {yes_real}) / (10 + {voted_real})),
      'f', transform(sequence(0, 3 * {last} + 2), j -> (2 + {yes_not}) / (10 + {voted_not})),
      'share', transform(sequence(0, {last}), k -> (1 + {kind_real}) / (2 + {kind_all})))))
"""


def _posterior(state: str) -> str:
    """P(real | votes) of pattern x, with the votes independent given the truth."""
    real, fake = [f"element_at({state}.share, x.kind + 1)"], [f"(1 - element_at({state}.share, x.kind + 1))"]
    for j, name in enumerate(_LABELERS):
        at = f"[3 * x.kind + {j}]"
        real.append(f"case x.{name} when 2 then {state}.t{at} when 0 then 1 - {state}.t{at} else 1D end")
        fake.append(f"case x.{name} when 2 then {state}.f{at} when 0 then 1 - {state}.f{at} else 1D end")
    a, b = " * ".join(real), " * ".join(fake)
    return f"({a}) / ({a} + {b})"


def _total(of: str, where: str) -> str:
    return f"aggregate(q, 0D, (total, y) -> total + case when {where} then {of} else 0D end)"


def fit(docs: DataFrame) -> SpanModel:
    """Reliabilities by EM and the final classifier, from all candidates of ``docs``; without any, nothing is learnt."""
    return _fit(candidates(docs.select("text")), "found")


def _fit(table: DataFrame, column: str) -> SpanModel:
    found = table.select(F.explode(column).alias("c")).select("c.*")
    votes = found.groupBy("kind", *_LABELERS).agg(F.count("*").cast("double").alias("n"))
    one = votes.agg(F.sort_array(F.collect_list(F.struct("kind", *_LABELERS, "n"))).alias("p"))
    vote, own = "element_at(array(y.x.form, y.x.known, y.x.near), j % 3 + 1)", "y.x.kind = j div 3"
    sql = _FIT.format(
        rounds=ROUNDS,
        last=len(KINDS) - 1,
        posterior=_posterior("s"),
        yes_real=_total("y.x.n * y.r", f"{own} and {vote} = 2"),
        voted_real=_total("y.x.n * y.r", f"{own} and {vote} <> 1"),
        yes_not=_total("y.x.n * (1 - y.r)", f"{own} and {vote} = 2"),
        voted_not=_total("y.x.n * (1 - y.r)", f"{own} and {vote} <> 1"),
        kind_real=_total("y.x.n * y.r", "y.x.kind = k"),
        kind_all=_total("y.x.n", "y.x.kind = k"),
    )
    state = one.withColumn("s", F.expr(sql)).withColumn("q", F.expr(f"transform(p, x -> struct(x, {_posterior('s')} as r))")).first()
    if not state.q:
        return SpanModel({}, {}, {})
    reliability = {(kind, name): (state.s.t[3 * k + j], state.s.f[3 * k + j]) for k, kind in enumerate(KINDS) for j, name in enumerate(_LABELERS)}
    # The final classifier: log-odds of each feature value under the expected labels, which are looked up by the votes.
    expected = F.create_map(*(x for y in state.q for x in (F.lit(_pattern(y.x)), F.lit(y.r))))
    pattern = F.col("kind") * 27 + F.col("form") * 9 + F.col("known") * 3 + F.col("near")
    real = found.withColumn("r", F.element_at(expected, pattern))
    long = real.select("kind", "r", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in _FEATURES))).alias("v"))
    counted = long.groupBy("kind", "v.name", "v.value").agg(F.sum("r").alias("real"), F.sum(1 - F.col("r")).alias("fake")).collect()
    totals = {}
    for x in counted:
        if x.name == "edge":
            a, b = totals.get(x.kind, (0.0, 0.0))
            totals[x.kind] = a + x.real, b + x.fake
    bias = {k: math.log((a + 1) / (b + 1)) for k, (a, b) in totals.items()}
    odds = lambda n, all_, size: math.log((n + 1) / (all_ + size))
    weights = {(x.kind, x.name, x.value): odds(x.real, totals[x.kind][0], _FEATURES[x.name]) - odds(x.fake, totals[x.kind][1], _FEATURES[x.name]) for x in counted}
    return SpanModel(bias, weights, reliability)


def _pattern(x) -> int:
    return x.kind * 27 + x.form * 9 + x.known * 3 + x.near


def _log_odds(s: Column, model: SpanModel) -> Column:
    """The final classifier's log-odds that a candidate is real; its weights are one literal array."""
    flat, at = [], {}
    for k, bias in sorted(model.bias.items()):
        at[k] = len(flat)
        flat.append(bias)
        for name, size in _FEATURES.items():
            flat += [model.weights.get((k, name, v), 0.0) for v in range(size)]
    if not flat:
        return F.lit(0.0)
    table = F.expr("cast(split('" + ",".join(map(repr, flat)) + "', ',') as array<double>)")
    base = F.lit(-1)
    for k, first in at.items():
        base = F.when(s.kind == k, first).otherwise(base)
    total, skip = F.element_at(table, base + 1), 1
    for name, size in _FEATURES.items():
        total = total + F.element_at(table, base + (skip + 1) + s[name])
        skip += size
    return F.when(base < 0, F.lit(0.0)).otherwise(total)


def find_spans(docs: DataFrame, model: SpanModel | None = None, keep: float = KEEP, column: str = "spans") -> DataFrame:
    """``docs`` with ``column``: array<struct<start,kind,end,base>> by start, then kind in the order of ``KINDS``.

    Positions are code points, end exclusive.  Null texts count as empty and have no spans; rows are kept
    as they are, repeated or not, and other columns pass unchanged (one of that name is replaced).  An empty table gives no rows.
    Without a model one is fitted on ``docs``, whose rows are then stored with their candidates and read again.
    """
    found = fresh(docs, "found")
    table = candidates(docs, found)
    if model is None:
        if not any(isinstance(f.dataType, NullType) for f in docs.schema):  # Parquet has no such columns
            table = materialise(table, "candidates")
        model = _fit(table, found)
    least = math.log(keep / (1 - keep))
    kept = F.filter(found, lambda s: (s.kind < len(BASE)) | (_log_odds(s, model) >= least))
    spans = F.array_sort(F.transform(kept, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), (s.kind < len(BASE)).alias("base"))))
    return table.withColumn(column, spans).drop(found)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets, ``n_chars`` set anew if there.

    Where spans overlap, the one that starts first is replaced, and what of the others reaches
    beyond it goes too.  A null text stays null.
    """
    columns = docs.columns
    name = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s.start >= state.at
        text = F.concat(state.out, F.col("text").substr(state.at + 1, F.greatest(s.start - state.at, F.lit(0))), F.when(fresh, F.element_at(name, s.kind + 1)).otherwise(""))
        return F.struct(F.greatest(state.at, s.end).alias("at"), text.alias("out"))

    spans = fresh(docs, "spans")
    clean = F.aggregate(spans, start, step, lambda s: F.concat(s.out, F.col("text").substr(s.at + 1, F.length("text"))))
    out = find_spans(docs, model, column=spans).withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)
