"""DuckDB forms of the registered queries, built from the same language profile."""

from __future__ import annotations

from corpusloom.functions.profiles import FRENCH_ENGLISH as PAIR
from corpusloom.functions.text import CLOCK, MAX_CHARS
from corpusloom.operators import density as D
from corpusloom.operators.annotation import LIKELY_TYPOS

TOKEN = PAIR.token


def words_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def any_of(column: str, letters: str) -> str:
    return f"regexp_matches({column}, '[{letters}]')" if letters else "false"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def lowered(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda w: lower(w))"


NORM_KEY = "md5(" + squeeze(r"regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g')") + ")"
TOKEN_KEY = f"CASE WHEN len({tokens('text')}) >= 3 THEN md5(array_to_string(list_sort({lowered('text')}), ' ')) END"
TXT = rf"""
anonymous AS (SELECT doc_id AS seq, source AS video_id, lang AS source_file, string_split(
    trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+', '<URL>', 'g'), '@[\p{{L}}\p{{N}}_.Ѐ-ӿ-]+', '<USER>', 'g'), '\s+', ' ', 'g')), '') AS l FROM documents),
txt AS (SELECT seq, video_id, source_file, array_to_string(list_transform(l, lambda c, i: CASE WHEN i > 3 AND c = l[i - 1] AND c = l[i - 2] AND c = l[i - 3] THEN '' ELSE c END), '') AS text FROM anonymous)"""


def bucket(a: str, b: str, empty: str = "unknown") -> str:
    return f"CASE WHEN {a} + {b} = 0 THEN '{empty}' WHEN {a} = 0 OR {b} = 0 THEN 'mono' WHEN least({a}, {b}) / ({a} + {b}) <= 0.2 THEN 'low' WHEN least({a}, {b}) / ({a} + {b}) <= 0.4 THEN 'med' ELSE 'high' END"


def routed(max_chars: int = MAX_CHARS) -> str:
    n = f"len({tokens('text')})"
    other = PAIR.script_names[1]
    clock = CLOCK.replace("'", "''")
    promo = "|".join(PAIR.promo)
    return f"""{TXT},
routed AS (SELECT *, CASE
    WHEN length(text) > {max_chars} THEN 'drop:too_long'
    WHEN NOT {any_of('text', PAIR.main_class + PAIR.other_class)} THEN 'drop:no_letters'
    WHEN regexp_matches(text, '{clock}') AND len({tokens(f"regexp_replace(text, '{clock}', ' ', 'g')")}) < 3 THEN 'drop:timestamp_only'
    WHEN (regexp_matches(text, 'https?://\\S+|www\\.\\S+') OR contains(text, '<URL>')) AND regexp_matches(text, '(?i){promo}') THEN 'drop:promo'
    WHEN {n} < 3 THEN 'drop:too_few_tokens'
    WHEN NOT {any_of('text', PAIR.main_class)} THEN 'romanized:{other}_script'
    WHEN {n} < 5 THEN 'too_short:below_density_threshold'
    ELSE 'ok:' END AS outcome FROM txt)"""


def dedup(max_chars: int = MAX_CHARS) -> str:
    return f"""{routed(max_chars)},
keyed AS (SELECT *, {NORM_KEY} AS norm_key, {TOKEN_KEY} AS token_key, split_part(outcome, ':', 1) AS status, split_part(outcome, ':', 2) AS reason FROM routed),
pasted AS (SELECT norm_key FROM keyed GROUP BY norm_key HAVING count(DISTINCT video_id) >= 3),
step1 AS (SELECT *, CASE WHEN status = 'drop' THEN reason WHEN norm_key IN (SELECT norm_key FROM pasted) THEN 'copypasta' END AS r1 FROM keyed),
step2 AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN row_number() OVER (PARTITION BY r1 IS NULL, norm_key ORDER BY seq) > 1 THEN 'exact_duplicate' END AS r2 FROM step1),
deduped AS (SELECT *, CASE WHEN r2 IS NOT NULL THEN r2 WHEN token_key IS NOT NULL AND row_number() OVER (PARTITION BY r2 IS NULL, token_key ORDER BY seq) > 1 THEN 'reordered_duplicate' END AS drop_reason FROM step2)"""


def screened() -> str:
    only_a = [w for w in PAIR.screen_a if w not in PAIR.screen_ambiguous]
    is_b, is_a = f"w IN {words_in(PAIR.screen_b)}", f"(w IN {words_in(only_a)} OR {any_of('w', PAIR.letters_a)})"
    return f"""{TXT},
votes AS (SELECT seq, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS w FROM txt),
counted AS (SELECT seq, count(*) FILTER ({is_b}) AS b, count(*) FILTER (NOT ({is_b}) AND {is_a}) AS a FROM votes WHERE w NOT IN {words_in(PAIR.screen_neutral)} GROUP BY seq),
both_ AS (SELECT txt.*, coalesce(a, 0) AS screen_a, coalesce(b, 0) AS screen_b FROM txt LEFT JOIN counted USING (seq)),
screened AS (SELECT *, {bucket('screen_a', 'screen_b')} AS screen_bucket FROM both_)"""


def language_scores() -> str:
    columns = [f"CASE WHEN {any_of('w', PAIR.evidence_letters)} THEN 1 ELSE 0 END AS evidence"]
    for n in PAIR.neighbours:
        marked = f"w IN {words_in(n.markers)}" + "".join(f" OR (starts_with(w, '{m}') AND length(w) <= {len(m) + 4})" for m in n.markers if len(m) >= 4)
        total = f"CASE WHEN {marked} THEN 2 ELSE 0 END + CASE WHEN {any_of('w', n.letters)} THEN {n.letter_weight} ELSE 0 END"
        total += "".join(f" + CASE WHEN regexp_matches(w, '{p}') THEN 1 ELSE 0 END" for p in n.patterns)
        columns.append(f"{total} AS {n.code}")
    names = ["evidence", *(n.code for n in PAIR.neighbours)]
    return f"""{TXT},
main AS (SELECT seq, list_transform(regexp_extract_all(text, '[{PAIR.main_class}]+'), lambda w: lower(w)) AS l FROM txt),
each AS (SELECT seq, unnest(l) AS w FROM main),
scored AS (SELECT seq, {', '.join(columns)} FROM each),
sums AS (SELECT seq, {', '.join(f'sum({n}) AS {n}' for n in names)} FROM scored GROUP BY seq),
scores AS (SELECT main.seq, CAST(len(l) AS BIGINT) AS n, {', '.join(f'CAST(coalesce({n}, 0) AS BIGINT) AS {n}' for n in names)} FROM main LEFT JOIN sums USING (seq))"""


def detected() -> str:
    parts = []
    for k, n in enumerate(PAIR.neighbours):
        if n.letters:
            hit = f"{n.code} >= 3" + (" AND evidence <= 1" if k else "")
        else:
            hit = f"({n.code} >= 2 AND evidence = 0) OR ({n.code} >= 6 AND evidence <= 1)"
        parts.append(f"WHEN {hit} THEN '{n.code}'")
    return f"CASE WHEN n < 3 THEN NULL {' '.join(parts)} END"


# --- density -----------------------------------------------------------------------------------------


def frequencies() -> str:
    marked_b = f"(w IN {words_in(PAIR.func_b)} OR {any_of('w', PAIR.letters_b)})"
    return f"""{TXT},
listed AS (SELECT seq, {lowered('text')} AS l FROM txt),
occurrences AS (SELECT seq, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM listed),
marks AS (SELECT seq, count(*) AS n, count(*) FILTER ({any_of('w', PAIR.letters_a)}) AS ma, count(*) FILTER ({marked_b}) AS mb FROM occurrences GROUP BY seq),
sides AS (SELECT seq, CASE WHEN n < 4 THEN NULL WHEN ma >= 2 AND ma / n >= 0.25 AND mb = 0 THEN '{PAIR.a}' WHEN ma = 0 AND mb >= 2 THEN '{PAIR.b}' END AS side FROM marks),
freq AS (SELECT w AS word, count(*) FILTER (side = '{PAIR.a}') AS n_a, count(*) FILTER (side = '{PAIR.b}') AS n_b, count(*) AS n FROM occurrences JOIN sides USING (seq) GROUP BY w)"""


def seeds() -> str:
    return f"""{frequencies()},
totals AS (SELECT greatest(sum(n_a), 1) AS ta, greatest(sum(n_b), 1) AS tb FROM freq),
ratios AS (SELECT freq.*, (n_a / ta) / nullif(n_a / ta + n_b / tb, 0) AS p FROM freq, totals),
seeds AS (SELECT word, n, CASE WHEN word IN {words_in(PAIR.shared_seed)} THEN 'shared' WHEN {any_of('word', PAIR.letters_a)} THEN '{PAIR.a}'
    WHEN word IN {words_in(PAIR.stop_both)} OR n_a + n_b < 2 THEN NULL WHEN p BETWEEN 0.25 AND 0.75 AND n_a + n_b >= 8 THEN 'shared' WHEN p >= 0.9 THEN '{PAIR.a}' WHEN p <= 0.1 THEN '{PAIR.b}' END AS lang FROM ratios),
seeded AS (SELECT * FROM seeds WHERE lang IS NOT NULL)"""


def chars() -> str:
    return f"""{seeds()},
own AS (SELECT word, lang, least(n, {D.MOST_WEIGHT}) AS weight, '^^' || word || '$' AS s FROM seeded WHERE lang IN ('{PAIR.a}', '{PAIR.b}')),
places AS (SELECT lang, weight, s, unnest(range(1, length(s) - 1)) AS i FROM own),
grams AS (SELECT lang, weight, substr(s, i, 2) AS ctx, substr(s, i, 3) AS gram FROM places),
ctx AS (SELECT ctx, sum(weight) FILTER (lang = '{PAIR.a}') AS a, sum(weight) FILTER (lang = '{PAIR.b}') AS b FROM grams GROUP BY ctx),
gram AS (SELECT gram, sum(weight) FILTER (lang = '{PAIR.a}') AS a, sum(weight) FILTER (lang = '{PAIR.b}') AS b FROM grams GROUP BY gram),
alphabet AS (SELECT count(DISTINCT c) FILTER (lang = '{PAIR.a}') AS va, count(DISTINCT c) FILTER (lang = '{PAIR.b}') AS vb FROM (SELECT lang, unnest(string_split(word, '')) AS c FROM own))"""


def llr(source: str, name: str) -> str:
    """CTEs that end in ``name`` (word, llr) for the words of ``source``."""

    def log(g: str, c: str, v: str) -> str:
        return f"ln((coalesce({g}, 0) + 0.5) / (coalesce({c}, 0) + 0.5 * {v}))"

    return f"""
{name}_s AS (SELECT word, '^^' || word || '$' AS s FROM {source}),
{name}_p AS (SELECT word, s, unnest(range(1, length(s) - 1)) AS i FROM {name}_s),
{name} AS (SELECT word, avg({log('gram.a', 'ctx.a', 'va')}) - avg({log('gram.b', 'ctx.b', 'vb')}) AS llr FROM {name}_p LEFT JOIN gram ON gram.gram = substr(s, i, 3) LEFT JOIN ctx ON ctx.ctx = substr(s, i, 2), alphabet GROUP BY word)"""


def by_llr(x: str) -> str:
    return f"CASE WHEN {x} > {D.LLR_MARGIN} THEN '{PAIR.a}' WHEN {x} < -{D.LLR_MARGIN} THEN '{PAIR.b}' ELSE 'ambiguous' END"


def measured() -> str:
    seed_rule = f"CASE WHEN {any_of('word', PAIR.letters_a)} OR word IN {words_in(PAIR.func_a)} THEN '{PAIR.a}' WHEN {any_of('word', PAIR.letters_b)} OR word IN {words_in(PAIR.func_b)} THEN '{PAIR.b}' END"
    form = f"translate(word, '{PAIR.accents[0]}', '{PAIR.accents[1]}')"
    return f"""{chars()},
open_words AS (SELECT word FROM freq WHERE n >= {D.MIN_FREQ} AND word NOT IN {words_in(PAIR.stop_both)} AND word NOT IN (SELECT word FROM seeded)),{llr('open_words', 'guess')},
lexicon AS (SELECT word, lang, true AS confident FROM seeded UNION ALL SELECT word, {by_llr('llr')}, false FROM guess),
stripped AS (SELECT DISTINCT {form} AS form FROM lexicon WHERE lang = '{PAIR.a}' AND {any_of('word', PAIR.letters_a)}),
collided AS (SELECT form, form IN (SELECT word FROM lexicon WHERE lang = '{PAIR.b}') AS collision FROM stripped),
known AS (SELECT freq.word, lang, coalesce(confident, false) AS confident, CASE WHEN length(freq.word) >= 4 AND freq.word NOT IN {words_in(PAIR.func_b)} AND NOT {any_of('freq.word', PAIR.letters_a)} THEN {form.replace('word', 'freq.word', 1)} END AS form FROM freq LEFT JOIN lexicon USING (word)),
settled AS (SELECT word, CASE WHEN confident THEN lang WHEN collision THEN 'ambiguous' WHEN collision IS NOT NULL THEN '{PAIR.a}' WHEN lang IS NOT NULL THEN lang WHEN word IN {words_in(PAIR.stop_both)} THEN 'ambiguous' ELSE {seed_rule} END AS lang FROM known LEFT JOIN collided USING (form)),
rest AS (SELECT word FROM settled WHERE lang IS NULL),{llr('rest', 'late')},
word_lang AS (SELECT word, lang FROM settled WHERE lang IS NOT NULL UNION ALL SELECT word, {by_llr('llr')} FROM late),
tagged AS (SELECT seq, pos, lang FROM occurrences JOIN word_lang ON word = w),
sums AS (SELECT seq, count(*) FILTER (lang = '{PAIR.a}') AS a, count(*) FILTER (lang = '{PAIR.b}') AS b, count(*) FILTER (lang = 'shared') AS shared, arg_min(lang, pos) FILTER (lang IN ('{PAIR.a}', '{PAIR.b}')) AS opening FROM tagged GROUP BY seq),
based AS (SELECT txt.seq, coalesce(a, 0) AS a0, coalesce(b, 0) AS b0, coalesce(shared, 0) AS shared, CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN '' WHEN a > b THEN '{PAIR.a}' WHEN b > a THEN '{PAIR.b}' ELSE opening END AS base_lang FROM txt LEFT JOIN sums USING (seq)),
folded AS (SELECT *, a0 + CASE WHEN base_lang = '{PAIR.a}' THEN shared ELSE 0 END AS a, b0 + CASE WHEN base_lang = '{PAIR.b}' THEN shared ELSE 0 END AS b FROM based),
measured AS (SELECT seq, a, b, shared, CASE WHEN base_lang = '' THEN 0 ELSE a + b END AS counted, CASE WHEN base_lang = '' THEN '' ELSE {bucket('a', 'b')} END AS density, base_lang FROM folded)"""


# --- samples, sheets, predictions ---------------------------------------------------------------------

POOL = f"{screened()},\npool AS (SELECT seq AS comment_id, video_id, screen_bucket, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens, len({tokens('text')}) >= 5 AS density_eligible FROM screened)"


def shuffled(key: str = "comment_id", seed: int = 2026) -> str:
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


LABELLED = "labelled AS (SELECT d.doc_id, d.source, d.text, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
SHEETS = f"""{LABELLED},
sheets AS (SELECT source AS file, doc_id AS line, CAST(doc_id AS VARCHAR) AS comment_id,
    CASE WHEN n_chars % 7 = 0 THEN 'skip' WHEN n_chars % 11 = 0 THEN '' WHEN quality = 1 THEN 'pos' ELSE 'neg' END AS sentiment,
    CASE WHEN n_chars % 13 = 0 THEN 'hi' WHEN n_chars < 900 THEN 'mono' WHEN n_chars < 1800 THEN 'low' ELSE 'high' END AS density,
    CASE WHEN n_chars % 17 = 0 THEN '' WHEN toxic = 1 THEN 'kk' ELSE 'ru' END AS base_lang FROM labelled)"""
PREDICTIONS = f"""{LABELLED},
golden AS (SELECT doc_id AS comment_id, CASE WHEN toxic = 1 THEN 'neg' WHEN quality = 1 THEN 'pos' ELSE 'neu' END AS gold,
    CASE WHEN n_chars < 900 THEN 'mono' WHEN n_chars < 1500 THEN 'low' WHEN n_chars < 2500 THEN 'med' ELSE 'high' END AS density, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens, unnest(['rep_a', 'rep_b', 'rep_c']) AS representation FROM labelled),
preds AS (SELECT *, CASE WHEN substr(md5(representation || '|' || CAST(comment_id AS VARCHAR)), 1, 1) < CASE representation WHEN 'rep_a' THEN 'd' WHEN 'rep_b' THEN 'b' ELSE '9' END THEN gold WHEN gold = 'neg' THEN 'neu' WHEN gold = 'neu' THEN 'pos' ELSE 'neg' END AS pred FROM golden)"""


def label_scores(by: str) -> str:
    """Ends in ``scores`` (by, n, macro_f1, accuracy, floor, majority)."""
    return f"""{PREDICTIONS},
long AS (SELECT {by}, gold AS label, 1 AS g, 0 AS p, CASE WHEN gold = pred THEN 1 ELSE 0 END AS h FROM preds UNION ALL SELECT {by}, pred, 0, 1, 0 FROM preds),
per_label AS (SELECT {by}, label, sum(g) AS g, sum(p) AS p, sum(h) AS h FROM long GROUP BY ALL),
scores AS (SELECT {by}, CAST(sum(g) AS BIGINT) AS n, avg(CASE WHEN h = 0 THEN 0.0 ELSE CAST(2 * h AS DOUBLE) / (g + p) END) AS macro_f1, sum(h) / sum(g) AS accuracy, max(g) / sum(g) AS floor, arg_max(label, (g, label)) AS majority FROM per_label GROUP BY ALL)"""


SIGNIFICANCE = f"""{PREDICTIONS},
hits AS (SELECT comment_id, density, representation, pred = gold AS ok FROM preds),
pairs AS (SELECT x.representation AS a, y.representation AS b, x.density, x.ok AS ok_a, y.ok AS ok_b FROM hits x JOIN hits y USING (comment_id) WHERE x.representation < y.representation),
scopes AS (SELECT a, b, density AS scope, ok_a, ok_b FROM pairs UNION ALL SELECT a, b, 'all', ok_a, ok_b FROM pairs),
counts AS (SELECT a, b, scope, count(*) AS n, count(*) FILTER (NOT ok_a AND ok_b) AS n01, count(*) FILTER (ok_a AND NOT ok_b) AS n10 FROM scopes GROUP BY ALL HAVING count(*) >= 20),
tests AS (SELECT *, CASE WHEN n01 + n10 = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(n01, n10) + 1), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2))))) END AS p FROM counts),
steps AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, a, b, scope) + 1) * p AS step, row_number() OVER (ORDER BY p, a, b, scope) AS k FROM tests),
adjusted AS (SELECT *, least(1.0, max(step) OVER (ORDER BY k)) AS p_holm FROM steps)"""


def typo(value: str) -> str:
    return "CASE " + value + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LIKELY_TYPOS.items()) + " END"


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"
