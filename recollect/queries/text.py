"""Queries of the text functions: over documents and conversations, and over inline rows that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators import ledger, repair, wiki
from recollect.queries.views import TURNS, count_tokens
from recollect.registry import query
from recollect.schemas import table, turns_of_conversations

QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)

# --- DuckDB forms of the functions -------------------------------------------------------------------------------


def crude(w: str) -> str:
    return f"case when {w} not in ({QUOTED(C.INVARIANT_NOUNS)}) and length({w}) > 4 and {w} like '%ies' then left({w}, -3) || 'y' when length({w}) > 4 and {w} like '%s' and {w} not like '%ss' then left({w}, -1) else {w} end"


def ascii_words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[a-z0-9]+')"


def retrieval_tokens(t: str) -> str:
    return f"list_distinct([{crude('w')} for w in {ascii_words(t)} if w not in ({QUOTED(C.QUERY_STOPWORDS)})])"


def _alias(w: str) -> str:
    return f"case {w} " + " ".join(f"when '{a}' then '{b}'" for a, b in C.SLOT_ALIASES.items()) + f" else {w} end"


def slot_tokens(t: str) -> str:
    return f"list_distinct([{crude('v')} for v in [{_alias('w')} for w in {ascii_words(t)}]])"


def singular(w: str) -> str:
    irregular = " ".join(f"when {w} = '{a}' then '{b}'" for a, b in C.IRREGULAR_SINGULARS.items())
    kept = " and ".join(f"{w} not like '%{e}'" for e in ("ses", "zes", "ches", "shes"))
    return f"case {irregular} when length({w}) > 4 and {w} like '%ies' then left({w}, -3) || 'y' when length({w}) > 4 and {w} like '%es' and {kept} then left({w}, -2) when length({w}) > 3 and {w} like '%s' and {w} not like '%ss' then left({w}, -1) else {w} end"


def identity_tokens(t: str) -> str:
    return f"list_distinct([{singular('w')} for w in {ascii_words(t)} if w not in ({QUOTED(C.IDENTITY_STOPWORDS)})])"


def subject_part(k: str) -> str:
    return f"case when contains({k}, '.') then regexp_extract({k}, '(?s)^(.*)\\.[^.]*$', 1) else {k} end"


def attribute_part(k: str) -> str:
    return f"case when contains({k}, '.') then regexp_extract({k}, '(?s)\\.([^.]*)$', 1) else '' end"


def canonical_key(k: str) -> str:
    return f"array_to_string(list_sort({identity_tokens(k)}), ' ')"


def quantity(v: str) -> str:
    return f"(regexp_matches({v}, '[0-9]') or list_has_any(regexp_extract_all(lower({v}), '[a-z]+'), [{QUOTED(C.NUMBER_WORDS)}]))"


def needle_form(t: str) -> str:
    spell = "case w " + " ".join(f"when '{a}' then '{b}'" for a, b in C.CARDINALS.items()) + " else w end"
    return f"trim(regexp_replace(array_to_string([{spell} for w in regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')], ''), '[^a-z0-9]+', ' ', 'g'))"


def sentences(t: str) -> str:
    return f"[s for s in string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) if s <> '']"


def question_mode(q: str) -> str:
    return "case " + " ".join(f"when regexp_matches({q}, '(?i){p}') then '{m}'" for m, p in C.QUESTION_MODES) + " else 'current' end"


def temporal(q: str) -> str:
    return f"list_has_any(regexp_extract_all(lower({q}), '[a-z]+'), [{QUOTED(C.TEMPORAL_TERMS)}])"


def slot_key(t: str) -> str:
    out = []
    for key, parts, more in C.SLOT_KEYS:
        test = "(" + " or ".join(f"contains(lower({t}), '{p}')" for p in parts) + ")"
        if more:
            test += f" and regexp_matches(lower({t}), '{more}')" if "\\" in more else f" and contains(lower({t}), '{more}')"
        out.append(f"when {test} then '{key}'")
    return "case " + " ".join(out) + " end"


def slot_value(k: str, t: str) -> str:
    found = lambda p, g: f"nullif(regexp_extract({t}, '(?i){p}', {g}), '')"
    out = []
    for key, (pattern, group) in C.SLOT_VALUES.items():
        value = found(pattern, group)
        if key == "infra.host":
            alone = found(C.HOST_ALONE, 1)
            value = f"coalesce({value}, case when lower({alone}) not in ('is', 'to', 'set') then {alone} end)"
        if key == "infra.retention":
            value = f"nullif(trim(regexp_replace(trim({value}), '(?i) exactly$', '')), '')"
        out.append(f"when {k} = '{key}' then {value}")
    return "case " + " ".join(out) + " end"


# --- Inline rows -------------------------------------------------------------------------------------------------

KEYS = """select * from (values (1, 'user.team size', 'team size.sizes'), (2, 'device.start time', 'device.end time'), (3, 'goals.min level', 'goals.max level'), (4, 'kitchen.fridge temperature', 'kitchen.freezer temperature'),
(5, 'workout.sets', 'workout.reps'), (6, 'apex goal.target level', 'apex goal.level target'), (7, 'people.number of children', 'person.child'), (8, 'car.models', 'car.model'), (9, 'battery', 'batteries.total'),
(10, 'node 1.status', 'node 2.status'), (11, 'a.b.c', 'a.b.c'), (12, 'route.monday departure', 'route.friday departure')) as t(n, a, b)"""
QUESTIONS = """select * from (values (1, 'What is my team size?'), (2, 'What was the price in May?'), (3, 'How much did it increase from 3 to 5?'), (4, 'Which car did I have before?'), (5, 'How many miles in total across all trips?'),
(6, 'Who was there on Monday?'), (7, 'Did I switch plans?'), (8, 'What did I start with, as of 2023?'), (9, 'original colour?'), (10, 'and now')) as t(n, q)"""
STATEMENTS = """select * from (values (1, 'The rate limit is 1,200 requests per minute now.'), (2, 'Move the replica to eu-west-2 today.'), (3, 'The host is vega-archive-02.'), (4, 'Use host set for it.'), (5, 'Set port to 8443.'),
(6, 'The project is codenamed Bluebird, quietly.'), (7, 'Please use duckdb instead of sqlite.'), (8, 'The threshold is 0.83 at night.'), (9, 'Raw logs are retained for 30 days exactly.'), (10, 'Support calls came in.'), (11, 'Nothing of the kind.'), (12, 'A region without a zone')) as t(n, s)"""
NEEDLES = """select * from (values (1, 'five engineers', 'We have 5 engineers.', 'team.size', '5'), (2, 'level 100', 'target level: 100', 'goal.target level', '100'), (3, 'F-150', 'a Ford f 150 truck', 'car.model', 'F-150'), (4, '5 engineers', 'fifteen engineers', 'team.size', '15'),
(5, '', 'anything', 'x', 'y'), (6, 'twenty one', 'about 20 1', 'n', '20'), (7, 'two', 'two_way street', 'n', 'two'), (8, '42 km', 'it was 42km', 'run.distance in km', '42')) as t(n, needle, body, k, v)"""


# --- Queries -----------------------------------------------------------------------------------------------------


@query(f"select doc_id, {count_tokens('text')}::bigint as tokens from documents")
def text_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1."""
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query("select doc_id, sha256(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as normalised, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as squeezed from documents")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalised(F.col("text")), 256).alias("normalised"), F.sha2(X.squeezed(F.col("text")), 256).alias("squeezed"))


@query(f"select conv_id, turn, len({sentences('text')})::bigint as n, {sentences('text')}[1] as first_sentence from conversations")
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3."""
    own = table(spark, sf_dir, "conversations").withColumn("s", X.sentences(F.col("text")))
    return own.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.try_element_at("s", F.lit(1)).alias("first_sentence"))


_DROP = "[x for x in string_split(array_to_string([l for l in [array_to_string([s for s in string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) if s <> '' and not regexp_matches(s, '(^|[^\\p{L}\\p{N}_])(the|of)([^\\p{L}\\p{N}_]|$)')], ' ') for line in string_split(text, chr(10))] if l <> ''], chr(10)), chr(2)) if x is not null][1]"


@query(f"select conv_id, turn, sha256(coalesce({_DROP}, '')) as kept from conversations")
def text_without_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without the sentences that hold one of two words."""
    values = F.array(F.lit("the"), F.lit("of"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(X.without_values(F.col("text"), values), 256).alias("kept"))


@query(f"with {TURNS} select namespace, turn_id, upper(role) || ': ' || content as line, 'Turn ' || turn_id || ' [Session ' || session_id || '] - ' || upper(role) || ': ' || content as numbered from turns")
def text_turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF2, S24."""
    c = F.col
    return turns_of_conversations(spark, sf_dir).select("namespace", "turn_id", X.turn_line(c("role"), c("content")).alias("line"), X.numbered_turn_line(c("turn_id"), c("role"), c("content"), c("session_id"), c("ts")).alias("numbered"))


@query(f"select doc_id, list_sort({retrieval_tokens('text')}) as tokens from documents")
def text_retrieval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.retrieval_tokens(F.col("text"))).alias("tokens"))


@query(f"with t as ({KEYS}) select n, list_sort({slot_tokens('a')}) as slot_a, list_sort({identity_tokens('a')}) as identity_a, {canonical_key('a')} as full_a, {canonical_key('(' + subject_part('a') + ')')} as subject_a, list_has_any({identity_tokens('a')}, {identity_tokens('b')}) as blocked from t")
def text_key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID6, S9, J13: words and canonical forms of slot keys."""
    a, b = F.col("a"), F.col("b")
    return spark.sql(KEYS).select(
        "n", F.array_sort(X.slot_tokens(a)).alias("slot_a"), F.array_sort(X.identity_tokens(a)).alias("identity_a"), X.canonical_key(a).alias("full_a"), X.canonical_key(a, "subject").alias("subject_a"), F.arrays_overlap(X.identity_tokens(a), X.identity_tokens(b)).alias("blocked"),
    )


@query(f"with t as ({QUESTIONS}) select n, {question_mode('q')} as mode, {temporal('q')} as temporal, {temporal('q')} or {question_mode('q')} in ('previous', 'change', 'point-in-time') as history from t")
def text_question_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7, R9, PF8."""
    q = F.col("q")
    return spark.sql(QUESTIONS).select("n", X.question_mode(q).alias("mode"), X.is_temporal(q).alias("temporal"), X.wants_history(q).alias("history"))


@query(f"select item_id, 'Question mode: ' || mode || '. ' || case mode {' '.join(f"when '{k}' then '{v}'" for k, v in C.MODE_INSTRUCTIONS.items())} end as instruction from (select item_id, {question_mode('text')} as mode from benchmark)")
def text_mode_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8."""
    return table(spark, sf_dir, "benchmark").select("item_id", X.mode_instruction(F.col("text")).alias("instruction"))


@query(f"with t as ({STATEMENTS}), k as (select *, {slot_key('s')} as slot_key from t) select n, slot_key, {slot_value('slot_key', 's')} as slot_value from k")
def text_known_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID2, ID3, S33: slots and values by keyword and pattern."""
    own = spark.sql(STATEMENTS).withColumn("slot_key", X.slot_key(F.col("s")))
    return own.select("n", "slot_key", X.slot_value(F.col("slot_key"), F.col("s")).alias("slot_value"))


_OVERRIDE = "case " + " ".join("when " + " or ".join(f"contains(lower(s), '{p}')" for p in parts) + f" then '{s}.{a}'" for s, a, parts in C.SLOT_OVERRIDES) + " end"


@query(f"with t as ({STATEMENTS}) select n, {_OVERRIDE} as slot_key from t")
def text_slot_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID1."""
    return spark.sql(STATEMENTS).select("n", X.slot_override(F.col("s")).alias("slot_key"))


_KIND = "case slot_key " + " ".join(f"when '{k}' then '{v}'" for k, v in C.SLOT_KINDS.items()) + " else 'entity' end"


@query(f"with t as ({STATEMENTS}), k as (select n, unnest({sentences('s')}) as text from t), v as (select *, {slot_key('text')} as slot_key from k), w as (select *, {slot_value('slot_key', 'text')} as slot_value from v) select n as source_turn_id, {_KIND} as kind, text, slot_key, slot_value from w where slot_value is not null")
def text_extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns to facts without a model."""
    turns = spark.sql(STATEMENTS).select(F.lit("n").alias("namespace"), F.col("n").cast("long").alias("turn_id"), F.col("s").alias("content"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("ts"))
    return ledger.extracted_facts(turns).select(F.col("source_turn_id").cast("int").alias("source_turn_id"), "kind", "text", "slot_key", "slot_value")


_PRESENT = f"({needle_form('needle')} <> '' and contains(' ' || {needle_form('body')} || ' ', ' ' || {needle_form('needle')} || ' '))"
_VALUES = f"string_split({needle_form('v')}, ' ')"
_WORDS = f"[w for w in string_split({needle_form('needle')}, ' ') if w <> '']"
_AWARE = f"(len([w for w in {_WORDS} if regexp_full_match(w, '[0-9]+')]) > 0 and len([w for w in {_WORDS} if regexp_full_match(w, '[0-9]+') and not list_contains({_VALUES}, w)]) = 0 and (len([w for w in {_WORDS} if not regexp_full_match(w, '[0-9]+')]) = 0 or list_has_any([w for w in {_WORDS} if not regexp_full_match(w, '[0-9]+')], list_concat(string_split({needle_form('k')}, ' '), {_VALUES}))))"


@query(f"with t as ({NEEDLES}) select n, {needle_form('needle')} as form, {_PRESENT} as present, {_AWARE} as in_value from t")
def text_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, S7, S8."""
    c = F.col
    return spark.sql(NEEDLES).select("n", X.needle_form(c("needle")).alias("form"), X.present(c("needle"), c("body")).alias("present"), X.value_aware_match(c("needle"), c("k"), c("v")).alias("in_value"))


@query("select d.doc_id, count(*) as n_items from documents d join benchmark b on contains(' ' || " + needle_form("d.text") + " || ' ', ' ' || " + needle_form("b.text") + " || ' ') where " + needle_form("b.text") + " <> '' group by d.doc_id")
def text_needles_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found in documents, word by word. Needles meet only documents that have their longest word."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    hay = table(spark, sf_dir, "documents").select("doc_id", X.needle_form(F.col("text")).alias("hay"))
    needles = table(spark, sf_dir, "benchmark").select("item_id", X.needle_form(F.col("text")).alias("needle")).filter("needle <> ''")
    key = F.array_max(F.transform(words(F.col("needle")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    posted = hay.select("doc_id", F.explode(F.array_distinct(words(F.col("hay")))).alias("word"))
    asked = needles.withColumn("word", key)
    pairs = posted.join(F.broadcast(asked) if asked.count() <= 10_000 else asked, "word").select("doc_id", "item_id", "needle")
    found = pairs.join(hay, "doc_id").filter(F.contains(F.concat(F.lit(" "), "hay", F.lit(" ")), F.concat(F.lit(" "), "needle", F.lit(" "))))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"))


@query(f"with t as ({NEEDLES}) select n, case when v = '' then 'missing' when regexp_matches(body, '[0-9]') then 'numeric' when regexp_matches(body, '[\\[\\]{{}}]') then 'collection' when len(string_split_regex(trim(body), '\\s+')) <= 8 then 'scalar' else 'prose' end as shape, {quantity('body')} as quantity, trim(translate(k, '._', '  ')) || ': ' || v as full_fact from t")
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID11, ID12, ID17."""
    c = F.col
    return spark.sql(NEEDLES).select("n", X.value_shape(c("body")).alias("shape"), X.quantity_like(c("body")).alias("quantity"), X.full_fact(c("k"), c("v")).alias("full_fact"))


@query("select page_id, regexp_matches(stem, '^[a-z0-9]+(-[a-z0-9]+)*$') as kebab, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '', 'g') as safe from (select *, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') as stem from pages)")
def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in kebab case, and made safe."""
    stem = F.regexp_replace(F.regexp_extract("url", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return table(spark, sf_dir, "pages").select("page_id", stem.rlike(C.KEBAB_CASE).alias("kebab"), X.safe_name(F.col("url")).alias("safe"))


@query(
    """with l as (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"#?]+)"', 1))) as link from pages), t as (select distinct lower(regexp_extract(url, '([^/]*)$', 1)) as name from pages)
select page_id, count(*) as n_links, count(*) filter (where lower(link) not in (select name from t)) as n_unresolved from l group by page_id"""
)
def wiki_unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead to no page, by an anti join."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"#?]+)"'), F.lit(1)))).alias("link")).withColumn("name", F.lower("link"))
    there = p.select(F.lower(F.regexp_extract("url", r"([^/]*)$", 1)).alias("name")).distinct()
    lost = links.join(there, "name", "left_anti").groupBy("page_id").agg(F.count("*").alias("n_unresolved"))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links")).join(lost, "page_id", "left").select("page_id", "n_links", F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"))


VAULT = """select * from (values ('v/wiki/good-page.md', '---|title: A|created: 2024|updated: 2024|---|see [[other-page]] and [[lost]]'), ('v/wiki/other-page.md', '---|title: B|created: 1|updated: 2|---|no link'), ('v/wiki/BadName.md', 'no front matter'),
('v/wiki/note.txt', 'x'), ('v/wiki/open.md', '---|title: C'), ('v/wiki/half.md', '---|title: D|created:|---|[[good-page]]')) as t(path, content)"""


@query(
    f"""with t as (select path, replace(content, '|', chr(10)) as content from ({VAULT})), p as (select *, regexp_extract(path, '([^/]*)$', 1) as name, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') as stem, path like '%.md' as md, starts_with(content, '---' || chr(10)) as opened, len(string_split(content, '---')) >= 3 as closed from t),
b as (select *, string_split(content, '---')[2] as front, string_split(content, '---')[3] as body from p where closed), l as (select path, unnest(regexp_extract_all(body, '\\[\\[([a-z0-9-]+)\\]\\]', 1)) as link from b)
select path, rule, count(*) as n from (
  select path, 'naming' as rule from p where not regexp_matches(stem, '^[a-z0-9]+(-[a-z0-9]+)*$') union all select path, 'naming' from p where not md
  union all select path, 'frontmatter' from p where md and not opened union all select path, 'frontmatter' from p where md and opened and not closed
  union all select path, 'frontmatter' from b where md and not (regexp_matches(front, '(?m)^title:[ \\t]*\\S') and regexp_matches(front, '(?m)^created:[ \\t]*\\S') and regexp_matches(front, '(?m)^updated:[ \\t]*\\S'))
  union all select path, 'links' from b where md and not regexp_matches(body, '\\[\\[[a-z0-9-]+\\]\\]') union all select path, 'unresolved_link' from l where link not in (select stem from p where md)) group by all"""
)
def wiki_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, SRC7, J3: rules that pages of a vault break."""
    files = spark.sql(VAULT).select("path", F.replace("content", F.lit("|"), F.lit("\n")).alias("content"))
    return wiki.violations(files).groupBy("path", "rule").agg(F.count("*").alias("n"))


RAW = """select * from (values (1, '```json|[1, 2]|```'), (2, '```|x'), (3, '{"a": 1} {"b": 2}'), (4, '  plain  '), (5, '{"a": 1}')) as t(n, raw)"""


@query(
    f"""with t as (select n, replace(raw, '|', chr(10)) as raw from ({RAW})), u as (select n, trim(raw) as r from t)
select n, case when regexp_matches(r, '(?s)```(?:json)?\\s*(.*?)\\s*```') then regexp_extract(r, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) else trim(regexp_replace(regexp_replace(r, '^```(?:json)?\\s*', ''), '```$', '')) end as inside,
case when r like '{{%}}' and regexp_matches(r, '\\}}\\s*\\{{') then '[' || regexp_replace(r, '\\}}\\s*\\{{', '}},{{', 'g') || ']' else r end as listed from u"""
)
def text_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14, S16."""
    own = spark.sql(RAW).select("n", F.replace("raw", F.lit("|"), F.lit("\n")).alias("raw"))
    return own.select("n", X.without_fences(F.col("raw")).alias("inside"), X.siblings_as_list(F.col("raw")).alias("listed"))


@query()
def text_token_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a run of eight to sixteen words that repeats at once."""
    return table(spark, sf_dir, "documents").select("doc_id", repair.token_loop("text").alias("looped"))
