"""The queries of queries.py as single DuckDB statements over the raw tables, written apart from the Spark code.

The stemmer here is a chain of columns of regular-expression tests on a string of consonant and vowel marks.
"""

from __future__ import annotations

#: The published stemmer's irregular forms, and the endings of its steps with what takes their place.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Words that begin a question, and the parameter grid.
QUESTION_WORDS = (
    "what why how when where who whose which whom can could should would is are was were am do does did has have had must may might shall will "
    "aren't isn't wasn't weren't don't doesn't didn't hasn't haven't hadn't can't cannot"
).split()
K1_GRID, B_GRID = (0.9, 1.2, 1.5, 1.8, 2.0), (0.3, 0.5, 0.65, 0.75, 0.9)
#: The stop words.
STOP_WORDS = """
    a about above across after afterwards again against all almost alone along already also although always am among
    amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became
    because become becomes becoming been before beforehand behind being below beside besides between beyond bill both
    bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight
    either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen
    fifty fill find fire first five for former formerly forty found four from front full further get give go had has
    hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie
    if in inc indeed interest into is it its itself keep last latter latterly least less ltd made many may me meanwhile
    might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine
    no nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our
    ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several
    she should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still
    such system take ten than that the their them themselves then thence there thereafter thereby therefore therein
    thereupon these they thick thin third this those though three through throughout thru thus to together too top
    toward towards twelve twenty two un under until up upon us very via was we well were what whatever when whence
    whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole
    whom whose why will with within without would yet you your yours yourself yourselves
""".split()

_TOKEN = r"[\p{L}\p{N}_]+"


def _marks(w: str) -> str:
    m = f"regexp_replace(regexp_replace(regexp_replace({w}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g'), '^y', 'c')"
    for _ in range(3):  # a run of y alternates; three rounds resolve runs of six
        m = f"replace(replace({m}, 'cy', 'cv'), 'vy', 'vc')"
    return m


def _ends(e: str) -> str:
    return f"suffix(w, '{e}')"


def _stem(e: str) -> str:
    return f"left(w, len(w) - {len(e)})" if e else "w"


def _m(e: str, pattern: str = "^c*v+c") -> str:
    return f"regexp_matches(left(m, len(w) - {len(e)}), '{pattern}')"


_MANY, _ONE = "^c*v+c+v+c", "^c*v+c+v*$"


def _short(e: str) -> str:
    s, m = _stem(e), f"left(m, len(w) - {len(e)})" if e else "m"
    return f"((suffix({m}, 'cvc') AND right({s}, 1) NOT IN ('w', 'x', 'y')) OR {m} = 'vc')"


def _case(rules: list[tuple[str, str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_ends(e)} THEN CASE WHEN {cond} THEN {_stem(e)} || '{new}' ELSE w END" for e, new, cond in rules) + " ELSE w END"


def _stemmer(words: str) -> list[str]:
    """CTEs that end in stemmed(word, stem)."""
    steps: list[tuple[str, str]] = []
    steps.append(("s1a", "CASE WHEN suffix(w, 'ies') AND len(w) = 4 THEN left(w, 3) ELSE " + _case([(e, n, "true") for e, n in STEP_1A]) + " END"))
    undone = "CASE WHEN suffix(w, 'ied') THEN CASE WHEN len(w) = 4 THEN left(w, 3) ELSE left(w, len(w) - 2) END WHEN suffix(w, 'eed') THEN CASE WHEN " + _m("eed") + " THEN left(w, len(w) - 1) ELSE w END "
    undone += "".join(f"WHEN {_ends(e)} AND contains(left(m, len(w) - {len(e)}), 'v') THEN '+' || {_stem(e)} " for e in ("ed", "ing")) + "ELSE w END"
    steps.append(("s1b", undone))
    # a leading + says that an ending was taken off and the rest is to be tidied
    tidy = "CASE WHEN NOT starts_with(o, '+') THEN w WHEN suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz') THEN w || 'e' "
    tidy += "WHEN len(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(m, 1) = 'c' THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE left(w, len(w) - 1) END "
    tidy += f"WHEN regexp_matches(m, '{_ONE}') AND {_short('')} THEN w || 'e' ELSE w END"
    steps.append(("s1t", tidy))
    steps.append(("s1c", "CASE WHEN suffix(w, 'y') AND len(w) > 2 AND left(right(m, 2), 1) = 'c' THEN left(w, len(w) - 1) || 'i' ELSE w END"))
    steps.append(("s2a", f"CASE WHEN suffix(w, 'alli') AND {_m('alli')} THEN left(w, len(w) - 2) ELSE w END"))
    steps.append(("s2", _case([(e, n, _m("ogi") if e == "logi" else _m(e)) for e, n in STEP_2])))
    steps.append(("s3", _case([(e, n, _m(e)) for e, n in STEP_3])))
    steps.append(("s4", _case([(e, "", _m(e, _MANY) + (f" AND right({_stem(e)}, 1) IN ('s', 't')" if e == "ion" else "")) for e in STEP_4])))
    steps.append(("s5a", f"CASE WHEN suffix(w, 'e') AND ({_m('e', _MANY)} OR ({_m('e', _ONE)} AND NOT {_short('e')})) THEN left(w, len(w) - 1) ELSE w END"))
    steps.append(("s5b", f"CASE WHEN suffix(w, 'll') AND {_m('l', _MANY)} THEN left(w, len(w) - 1) ELSE w END"))
    out = [f"p0 AS (SELECT DISTINCT word, word AS o FROM {words})"]
    last = "p0"
    for name, expr in steps:
        inner = f"(SELECT word, o, ltrim(o, '+') AS w, {_marks(chr(108) + 'trim(o, ' + chr(39) + '+' + chr(39) + ')')} AS m FROM {last})"
        out.append(f"{name} AS (SELECT word, {expr} AS o FROM {inner})")
        last = name
    known = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in IRREGULAR.items())
    out.append(f"stemmed AS (SELECT word, CASE word {known} ELSE CASE WHEN len(word) < 3 THEN word ELSE o END END AS stem FROM {last})")
    return out


def _kept(table: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"SELECT id, i, word FROM (SELECT id, unnest(l) AS word, unnest(range(len(l))) AS i FROM (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS l FROM {table})) WHERE len(word) > 1 AND word NOT IN ({stop})"


_DOCS = "d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, cast(doc_id AS VARCHAR) AS doc_id, text FROM documents)"
_INDEX = [
    _DOCS,
    "dt AS MATERIALIZED (" + _kept("(SELECT pos AS id, text FROM d)") + ")",
    "qt0 AS MATERIALIZED (" + _kept("(SELECT cast(item_id AS VARCHAR) AS id, text FROM benchmark)") + ")",
    "vocab AS (SELECT word FROM dt UNION SELECT word FROM qt0)",
    *_stemmer("vocab"),
    "stem_of AS MATERIALIZED (SELECT * FROM stemmed)",
    "post AS MATERIALIZED (SELECT id AS pos, stem AS term, count(*) AS tf, min(i) AS first_pos FROM dt JOIN stem_of USING (word) GROUP BY ALL)",
    "q AS MATERIALIZED (SELECT id AS query_id, stem AS term, cast(count(*) AS DOUBLE) AS qf FROM qt0 JOIN stem_of USING (word) GROUP BY ALL)",
    "lens AS (SELECT pos, sum(tf) AS dl FROM post GROUP BY pos)",
    "c AS MATERIALIZED (SELECT (SELECT count(*) FROM d) AS n, cast((SELECT sum(tf) FROM post) AS BIGINT) AS total_tokens, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM d) AS adl, 2000.0::DOUBLE AS mu, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b, 500.0::DOUBLE AS k2)",
    """t AS MATERIALIZED (SELECT term, df, ctf, ln(n / df) AS idf_standard, ln((n + 1) / (df + 1)) + 1 AS idf_smooth, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf_bm25,
        ln((1 - p) / p) AS idf_bim, df / n AS bim_pt, ctf / total_tokens AS p_collection
        FROM (SELECT *, least(greatest(df / n, 1e-12), 1 - 1e-12) AS p FROM (SELECT term, cast(count(*) AS DOUBLE) AS df, cast(sum(tf) AS DOUBLE) AS ctf FROM post GROUP BY term), c))""",
    "px AS MATERIALIZED (SELECT post.*, cast(dl AS DOUBLE) AS dl, (1 + ln(tf)) * idf_smooth AS tfidf FROM post JOIN t USING (term) JOIN lens USING (pos))",
    "nd AS MATERIALIZED (SELECT d.pos, doc_id, text, cast(coalesce(max(dl), 0) AS BIGINT) AS dl, coalesce(sqrt(sum(tfidf * tfidf)), 0) AS norm FROM d LEFT JOIN px USING (pos) GROUP BY ALL)",
]


def _top(parts: str, depth: int, order: str = "round(score, 9) DESC, pos") -> str:
    return f"SELECT query_id, pos, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({parts})) JOIN d USING (pos) WHERE rank <= {depth}"


def _bm25_sum(terms: str, weight: str, extra: str = "") -> str:
    return f"""SELECT query_id, pos, sum(idf_bm25 * (tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / adl))) * ({weight} * (k2 + 1) / ({weight} + k2))) AS score
        FROM {terms} JOIN t USING (term) JOIN px USING (term), c GROUP BY ALL"""


def _cosine(vector: str) -> str:
    return f"""SELECT query_id, pos, dot / (qn * norm) AS score FROM (SELECT query_id, pos, sum(weight * tfidf) AS dot FROM {vector} v JOIN px USING (term) GROUP BY ALL)
        JOIN (SELECT query_id, sqrt(sum(weight * weight)) AS qn FROM {vector} v GROUP BY query_id) USING (query_id) JOIN nd USING (pos) WHERE qn > 0 AND norm > 0"""


_QV = "qv AS MATERIALIZED (SELECT query_id, term, (1 + ln(qf)) * coalesce(idf_smooth, 0) AS weight FROM q LEFT JOIN t USING (term))"


def _bm25(name: str, depth: int) -> str:
    return f"{name} AS MATERIALIZED ({_top(_bm25_sum('q', 'qf'), depth)})"


_ROCCHIO = [
    _QV,
    _bm25("fb", 15),
    """grown AS MATERIALIZED (SELECT query_id, term, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 12) DESC, met) AS place
        FROM (SELECT query_id, term, sum(tfidf) / 15 * 0.6::DOUBLE AS weight, min({'r': rank, 'p': first_pos}) AS met FROM px JOIN fb USING (pos) GROUP BY ALL) ANTI JOIN q USING (query_id, term)) WHERE place <= 25)""",
    "rv AS MATERIALIZED (SELECT query_id, term, weight, false AS from_feedback FROM qv UNION ALL SELECT query_id, term, weight, true FROM grown)",
]
_RM3 = [
    _bm25("fm0", 10),
    "fm AS MATERIALIZED (SELECT *, score / sum(score) OVER (PARTITION BY query_id) AS p FROM fm0)",
    "rm1 AS (SELECT query_id, term, x / sum(x) OVER (PARTITION BY query_id) AS rm1 FROM (SELECT query_id, term, sum(p * ((tf + mu * p_collection) / (dl + mu))) AS x FROM px JOIN fm USING (pos) JOIN t USING (term), c GROUP BY ALL))",
    "pq AS (SELECT query_id, term, qf / sum(qf) OVER (PARTITION BY query_id) AS p_q FROM q SEMI JOIN fm USING (query_id))",
    """rw AS MATERIALIZED (SELECT query_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 12) DESC, encode(term)) AS place
        FROM (SELECT query_id, term, 0.5::DOUBLE * coalesce(p_q, 0) + 0.5::DOUBLE * coalesce(rm1, 0) AS weight FROM rm1 FULL JOIN pq USING (query_id, term))) WHERE place <= 20)""",
]


def _ranking(model: str, depth: int) -> tuple[list[str], str]:
    """CTEs that the ranking needs, and its SELECT."""
    if model == "bm25":
        return [], _top(_bm25_sum("q", "qf"), depth)
    if model == "vsm":
        return [_QV], _top(_cosine("qv"), depth)
    if model == "bim":
        return [], _top("SELECT query_id, pos, sum(idf_bim) AS score FROM q JOIN t USING (term) JOIN px USING (term) GROUP BY ALL", depth)
    if model == "lm_dirichlet":
        return [], _top("SELECT query_id, pos, sum(qf * ln((tf + mu * p_collection) / (dl + mu))) AS score FROM q JOIN t USING (term) JOIN px USING (term), c GROUP BY ALL HAVING score <> 0", depth)
    if model == "rocchio_prf":
        return _ROCCHIO, _top(_cosine("rv"), depth)
    if model == "rm3":
        return _RM3, _top(_bm25_sum("rw", "weight"), depth)
    ctes, fused = _fusion(2 * depth)
    sums = "SELECT query_id, pos, " + " + ".join(f"coalesce(max(CASE WHEN ranker = {i} THEN component END), 0)" for i in range(3)) + " AS score, min({'a': ranker, 'r': rank}) AS met FROM fused GROUP BY ALL"
    return [*ctes, fused], _top(sums, depth, "score DESC, met")


def _fusion(depth: int) -> tuple[list[str], str]:
    lists = [_ranking(m, depth) for m in ("bm25", "vsm", "rm3")]
    each = " UNION ALL ".join(f"SELECT *, {i} AS ranker FROM ({s})" for i, (_, s) in enumerate(lists))
    return [_QV, *_RM3], f"fused AS MATERIALIZED (SELECT query_id, pos, doc_id, ranker, rank, score AS raw, 1.0::DOUBLE / (60 + rank) AS component FROM ({each}))"


def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_QRELS = r"qrels AS MATERIALIZED (SELECT cast(item_id AS VARCHAR) AS query_id, cast(doc_id AS VARCHAR) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE regexp_matches(b.text, '\S'))"
_TOTALS = "totals AS (SELECT query_id, count(*) AS total FROM qrels GROUP BY query_id)"


def _flags(ranking: str, keys: str = "query_id") -> str:
    return f"SELECT r.*, coalesce(total, 0) AS total, q2.doc_id IS NOT NULL AS rel, sum(CASE WHEN q2.doc_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY rank) AS hits FROM ({ranking}) r LEFT JOIN qrels q2 USING (query_id, doc_id) LEFT JOIN totals USING (query_id)"


def _metric_rows(ranking: str) -> str:
    return f"""SELECT query_id, coalesce(ap, 0) AS ap, coalesce(p5, 0) AS p5, coalesce(p10, 0) AS p10, coalesce(ndcg10, 0) AS ndcg10
        FROM (SELECT cast(item_id AS VARCHAR) AS query_id FROM benchmark) LEFT JOIN (
          SELECT query_id, sum(CASE WHEN rel THEN hits / rank END) / max(total) AS ap, sum(CASE WHEN rel AND rank <= 5 THEN 1 ELSE 0 END) / 5 AS p5, sum(CASE WHEN rel AND rank <= 10 THEN 1 ELSE 0 END) / 10 AS p10,
            sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1) END) / list_sum(list_transform(range(1, least(max(total), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10
          FROM ({_flags(ranking)}) WHERE total > 0 GROUP BY query_id) USING (query_id)"""


_MEANS = "round(avg(ap), 6) AS map, round(avg(p5), 6) AS mean_p5, round(avg(p10), 6) AS mean_p10, round(avg(ndcg10), 6) AS mean_ndcg10"
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _cut(x: str, over: int, keep: int) -> str:
    return f"CASE WHEN len({x}) > {over} THEN left({x}, {keep}) || '...' ELSE {x} END"


def _title(doc_id: str) -> str:
    line = f"coalesce(nullif({_strip('string_split(' + _strip('text') + ', chr(10))[1]')}, ''), {doc_id})"
    return _cut(line, 88, 85)


def _flat(x: str = "text") -> str:
    return f"replace({x}, chr(10), ' ')"


def _explained(model: str, depth: int = 25) -> tuple[list[str], str]:
    """CTEs, of which the last is pairs: the model's ranking and the corpus's first document for every query."""
    ctes, select = _ranking(model, depth)
    return ctes, f"pairs AS MATERIALIZED (SELECT query_id, pos, doc_id FROM ({select}) UNION SELECT query_id, pos, doc_id FROM (SELECT DISTINCT query_id FROM q), (SELECT pos, doc_id FROM d WHERE pos = 0))"


def _explain(model: str) -> str:
    ctes, pairs = _explained(model)
    if model == "hybrid_rrf":
        more, fused = _fusion(400)
        names = "(VALUES (0, 'BM25'), (1, 'VSM'), (2, 'RM3')) AS n(ranker, name)"
        deep = fused.replace("fused AS", "deep AS", 1)
        return _with([*_INDEX, *ctes, pairs, *[x for x in more if x not in ctes], deep], f"SELECT p.query_id, p.doc_id, name AS ranker, rank, coalesce(round(raw, 6), 0) AS raw_score, coalesce(round(component, 6), 0) AS rrf_component FROM pairs p CROSS JOIN {names} LEFT JOIN deep f ON f.query_id = p.query_id AND f.pos = p.pos AND f.ranker = n.ranker")
    bm = "idf_bm25 * (tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / adl)))"
    spec = {
        "bm25": ("q", "qf * (k2 + 1) / (qf + k2)", f"{bm} * (qf * (k2 + 1) / (qf + k2))", "false"),
        "rm3": ("rw", "weight * (k2 + 1) / (weight + k2)", f"{bm} * (weight * (k2 + 1) / (weight + k2))", "false"),
        "vsm": ("qv", "weight", "weight * tfidf", "false"),
        "rocchio_prf": ("rv", "weight", "weight * tfidf", "from_feedback"),
        "bim": ("q", "idf_bim", "idf_bim", "false"),
        "lm_dirichlet": ("q", "qf", "qf * ln((tf + mu * p_collection) / (dl + mu))", "false"),
    }
    terms, weight, contribution, fed = spec[model]
    missing = "'missing_in_doc'" if model in ("vsm", "rocchio_prf") else "CASE WHEN NOT known THEN 'oov_index' ELSE 'missing_in_doc' END"
    # the terms asked of the documents asked are looked up first, so that the index is joined by them alone
    asked = f"asked AS MATERIALIZED (SELECT v.*, p.pos, p.doc_id FROM {terms} v JOIN pairs p USING (query_id))"
    held = "held AS MATERIALIZED (SELECT term, pos, tf, tfidf, dl FROM px SEMI JOIN asked USING (term, pos))"
    words = "words AS MATERIALIZED (SELECT term, t.idf_bm25, t.idf_bim, t.p_collection, t.term IS NOT NULL AS known FROM (SELECT DISTINCT term FROM asked) LEFT JOIN (SELECT * FROM t) t USING (term))"
    words = words.replace("t.term IS NOT NULL", "t.df IS NOT NULL")
    return _with([*_INDEX, *ctes, pairs, asked, held, words], f"""SELECT query_id, doc_id, term, CASE WHEN tf IS NOT NULL THEN 'matched' ELSE {missing} END AS status, round({weight}, 6) + 0.0 AS query_weight, tf AS tf_doc,
        CASE WHEN tf IS NULL THEN 0.0::DOUBLE ELSE round({contribution}, 6) + 0.0 END AS contribution, {fed} AS from_feedback
        FROM asked JOIN words USING (term) LEFT JOIN held USING (term, pos), c""")


def _segments() -> str:
    ctes, pairs = _explained("bm25", 3)
    cut = f"regexp_extract_all(text, '{_TOKEN}|[^\\p{{L}}\\p{{N}}_]+')"
    texts = "texts AS (SELECT cast(item_id AS VARCHAR) AS query_id, '' AS doc_id, -1 AS pos, text FROM benchmark UNION ALL SELECT query_id, p.doc_id, p.pos, left(text, 120000) AS text FROM pairs p JOIN d USING (pos))"
    sg = f"sg AS MATERIALIZED (SELECT query_id, doc_id, pos, unnest(l) AS text, cast(unnest(range(len(l))) AS INTEGER) AS ordinal FROM (SELECT query_id, doc_id, pos, {cut} AS l FROM texts))"
    marks = "marks AS MATERIALIZED (SELECT q.query_id, q.term, -1 AS pos FROM q UNION ALL SELECT q.query_id, q.term, p.pos FROM q JOIN pairs p USING (query_id) JOIN px ON px.term = q.term AND px.pos = p.pos)"
    seen = "seen AS MATERIALIZED (SELECT DISTINCT text, lower(text) AS word FROM sg)"
    stem = "word_stem AS MATERIALIZED (SELECT seen.text, s.stem FROM seen JOIN stem_of s USING (word))"
    return _with([*_INDEX, *ctes, pairs, texts, sg, marks, seen, stem], f"SELECT sg.query_id, doc_id, ordinal, sg.text, regexp_matches(sg.text, '^{_TOKEN}') AS word, m.term IS NOT NULL AS hit FROM sg LEFT JOIN word_stem s ON s.text = sg.text LEFT JOIN marks m ON m.query_id = sg.query_id AND m.pos = sg.pos AND m.term = s.stem")


def _grid() -> str:
    pairs = "(SELECT unnest([" + ", ".join(map(str, K1_GRID)) + "])::DOUBLE AS gk) CROSS JOIN (SELECT unnest([" + ", ".join(map(str, B_GRID)) + "])::DOUBLE AS gb)"
    scored = f"SELECT gk, gb, query_id, pos, sum(idf_bm25 * (qf * (k2 + 1) / (qf + k2)) * tf * (gk + 1) / (tf + gk * ((1 - gb) + gb * dl / adl))) AS score FROM q JOIN t USING (term) JOIN px USING (term), c, {pairs} GROUP BY ALL"
    ranked = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gk, gb, query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM ({scored})) JOIN d USING (pos) WHERE rank <= 25"
    per = f"SELECT gk, gb, query_id, coalesce(sum(CASE WHEN rel THEN hits / rank END), 0) / greatest(max(total), 1) AS ap FROM ({_flags(ranked, 'gk, gb, query_id')}) GROUP BY ALL"
    return _with([*_INDEX, _QRELS, _TOTALS], f"SELECT gk AS k1, gb AS b, round(sum(ap) / (SELECT count(*) FROM benchmark), 6) AS map FROM ({per}) GROUP BY ALL")


def _page() -> str:
    ranked = f"ranked AS MATERIALIZED ({_top(_bm25_sum('q', 'qf'), 25)})"
    sizes = "sizes AS (SELECT query_id, count(*) AS depth, least(5, greatest(1, ceil(count(*) / 5.0)))::BIGINT AS pages FROM ranked GROUP BY query_id)"
    matched = "matched AS (SELECT query_id, pos, count(*) AS matched_terms FROM q JOIN px USING (term) GROUP BY ALL)"
    return _with([*_INDEX, _QRELS, _TOTALS, ranked, sizes, matched], f"""SELECT query_id, least(2, pages) AS page, pages AS pager_total_pages, depth, rank, f.doc_id, round(score, 6) AS score,
        {_title('f.doc_id')} AS title, {_cut(_strip(_flat()), 280, 277)} AS snippet, nd.dl AS doc_tokens, round(nd.dl / adl, 4) AS length_ratio, matched_terms, query_terms,
        round(matched_terms / query_terms, 4) AS term_coverage, CASE WHEN total > 0 THEN rel END AS relevant, CASE WHEN total > 0 THEN round(hits / rank, 6) END AS precision_at_rank,
        CASE WHEN total > 0 THEN round(hits / total, 6) END AS recall_at_rank, CASE WHEN total > 0 THEN round(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END, 6) END AS dcg_increment
        FROM ({_flags('SELECT * FROM ranked')}) f JOIN sizes USING (query_id) JOIN matched USING (query_id, pos) JOIN (SELECT query_id, count(*) AS query_terms FROM q GROUP BY query_id) USING (query_id) JOIN nd USING (pos), c
        WHERE rank BETWEEN (least(2, pages) - 1) * 5 + 1 AND least(2, pages) * 5""")


def oracle_sql() -> dict[str, str]:
    lead = "|".join(w.replace("'", "''") for w in QUESTION_WORDS)
    out = {
        "tokens_filtered": _with(["dt AS (" + _kept("(SELECT doc_id AS id, text FROM documents)") + ")"], "SELECT id AS doc_id, word AS token, count(*) AS n FROM dt GROUP BY ALL"),
        "stems": _with(["dt AS (" + _kept("(SELECT doc_id AS id, text FROM documents)") + ")", *_stemmer("dt")], "SELECT word, stem FROM stemmed"),
        "doc_stats": _with(_INDEX, "SELECT pos, doc_id, dl, round(norm, 6) AS norm FROM nd"),
        "corpus_stats": _with(_INDEX, "SELECT n, round(adl, 6) AS adl, total_tokens, mu, k1, b, k2 FROM c"),
        "term_stats": _with(_INDEX, "SELECT term, cast(df AS BIGINT) AS df, cast(ctf AS BIGINT) AS ctf, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("idf_standard", "idf_smooth", "idf_bm25", "bim_pt", "p_collection")) + ", round(idf_bim, 6) + 0.0 AS idf_bim FROM t"),
        "postings_tfidf": _with(_INDEX, "SELECT term, pos, tf, round(tfidf, 6) AS tfidf, cast(dl AS BIGINT) AS dl FROM px"),
        "rocchio_terms": _with([*_INDEX, *_ROCCHIO], "SELECT query_id, term, round(weight, 6) AS weight, place FROM grown"),
        "rm3_terms": _with([*_INDEX, *_RM3], "SELECT query_id, term, round(weight, 6) AS weight FROM rw"),
        "judged_pairs": _with([_QRELS], "SELECT query_id, doc_id FROM qrels"),
        "eval_per_query": _with([*_INDEX, _QRELS, _TOTALS], "SELECT query_id, round(ap, 6) AS ap, round(p5, 6) AS p5, round(p10, 6) AS p10, round(ndcg10, 6) AS ndcg10 FROM (" + _metric_rows(_ranking("bm25", 25)[1]) + ")"),
        "eval_means": _with([*_INDEX, _QRELS, _TOTALS, _QV], f"SELECT {_MEANS} FROM ({_metric_rows(_ranking('vsm', 25)[1])})"),
        "bm25_grid": _grid(),
        "search_page": _page(),
        "title_snippet": f"SELECT cast(doc_id AS VARCHAR) AS doc_id, {_title('cast(doc_id AS VARCHAR)')} AS title, {_cut(_strip(_flat()), 280, 277)} AS snippet, {_cut(_flat(), 300, 300)} AS console, {_cut(_flat(), 140, 140)} AS echo, len(text) AS chars FROM documents",
        "question_filter": rf"SELECT conv_id, turn, s <> '' AND (suffix(s, '?') OR regexp_matches(s, '(?i)^({lead})([^\p{{L}}\p{{N}}_]|$)')) AS question, len(regexp_extract_all(text, '[^\s\x1c-\x1f\x85\p{{Z}}]+')) AS words FROM (SELECT *, {_strip('text')} AS s FROM conversations)",
        "paragraph_split": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda x: {_strip('x')}), lambda x: x <> '') AS many,
            list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS lines FROM documents),
            o AS (SELECT doc_id, CASE WHEN len(many) > 1 THEN many WHEN len(lines) > 0 THEN lines ELSE ['(Empty document.)'] END AS l FROM p)
            SELECT doc_id, cast(unnest(range(len(l))) AS INTEGER) AS place, unnest(l) AS paragraph FROM o""",
        "segments": _segments(),
    }
    out["rank_lookup"] = _with([*_INDEX, _QRELS], f"SELECT query_id, doc_id, rank, coalesce(round(score, 6), 0) AS score FROM qrels LEFT JOIN ({_ranking('bm25', 25)[1]}) USING (query_id, doc_id)")
    out["eval_report"] = _with([*_INDEX, _QRELS, _TOTALS], f"SELECT query_id, left(text, 60) AS query, round(ap, 6) AS ap, round(p5, 6) AS p5, round(p10, 6) AS p10, round(ndcg10, 6) AS ndcg10 FROM ({_metric_rows(_ranking('bim', 25)[1])}) JOIN (SELECT cast(item_id AS VARCHAR) AS query_id, text FROM benchmark) USING (query_id)")
    two = " UNION ALL ".join(f"SELECT query_id, pos, {i} AS ranker, rank, 1.0::DOUBLE / (60 + rank) AS component FROM ({_ranking(m, 50)[1]})" for i, m in enumerate(("lm_dirichlet", "bim")))
    sums = f"SELECT query_id, pos, coalesce(max(CASE WHEN ranker = 0 THEN component END), 0) + coalesce(max(CASE WHEN ranker = 1 THEN component END), 0) AS score, min({{'a': ranker, 'r': rank}}) AS met FROM ({two}) GROUP BY ALL"
    out["own_fusion"] = _with(_INDEX, f"SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({_top(sums, 25, 'score DESC, met')})")
    id_, text = "cast(item_id AS VARCHAR)", _strip("text")
    ways = [("'@' || id", "id", "text"), ("id || ' | ' || text", "id", text), ("id || chr(9) || text", "id", text), ("id || ': ' || text", "id", text), ("'  ' || text", "NULL", text), ("'@none' || id", "NULL", "''")]
    out["labelled_queries"] = " UNION ALL ".join(f"SELECT {line} AS line, {label} AS label, {shown} AS text FROM (SELECT {id_} AS id, text FROM benchmark)" for line, label, shown in ways)
    out["shown_scores"] = _with(_INDEX, f"SELECT query_id, doc_id, CASE WHEN abs(s) >= 100 THEN printf('%.2f', s) WHEN abs(s) >= 1 THEN printf('%.4f', s) ELSE printf('%.6f', s) END AS shown FROM (SELECT *, round(score, 9) AS s FROM ({_ranking('bm25', 25)[1]}))")
    models = ("bm25", "vsm", "bim", "lm_dirichlet", "hybrid_rrf", "rocchio_prf", "rm3")
    for model in models:
        ctes, select = _ranking(model, 25)
        out[model] = _with([*_INDEX, *ctes], f"SELECT query_id, doc_id, rank, round(score, 6) + 0.0 AS score FROM ({select})")
        out[f"explain_{model}"] = _explain(model)
    all_ctes = list(dict.fromkeys(x for m in models for x in _ranking(m, 25)[0]))
    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, {_MEANS} FROM ({_metric_rows(_ranking(m, 25)[1])})" for m in models)
    out["model_comparison"] = _with([*_INDEX, _QRELS, _TOTALS, *all_ctes], f"SELECT *, cast(row_number() OVER (ORDER BY map DESC, model) AS INTEGER) AS place, row_number() OVER (ORDER BY map DESC, model) = 1 AS best FROM ({rows})")
    return out
