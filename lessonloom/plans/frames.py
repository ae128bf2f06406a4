"""Driver tables as frames of the practice domain.

Each frame is SQL text that both engines read the same way (two texts where their
syntax differs), so a query and its oracle start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lessonloom.functions.session import plain_unions, small_tasks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FRAMES: dict[str, str] = {
    "students": "select c_custkey as id, c_name as name, n_name as school, c_mktsegment as grade, c_acctbal > 0 as active from @customer join @nation on c_nationkey = n_nationkey",
    "exams": "select o_orderkey as id, n_name as school, c_mktsegment as grade, o_orderdate as updated_at, o_orderdate as created_at from @orders join @customer on o_custkey = c_custkey join @nation on c_nationkey = n_nationkey",
    "current_exams": "select id, school, grade, updated_at from (select *, row_number() over (partition by school, grade order by updated_at desc, created_at desc, id desc) as rn from @exams) where rn = 1",
    "links": "select exam_id, passage_id, row_number() over (partition by exam_id order by line, passage_id) - 1 as position from (select l_orderkey as exam_id, l_partkey as passage_id, min(l_linenumber) as line from @lineitem group by l_orderkey, l_partkey)",
    "passages": "select p_partkey as id, p_name as title, p_brand as grade, concat(p_type, ' · Part ', p_size) as source_label, p_size as display_order, p_partkey % 5 as revision from @part",
    "graded_passages": "select p_partkey as id, p_name as title, case p_partkey % 5 when 0 then 'AUTOMOBILE' when 1 then 'BUILDING' when 2 then 'FURNITURE' when 3 then 'HOUSEHOLD' else 'MACHINERY' end as grade, p_size as display_order from @part",
    "home_attempts": "select a.id, a.student_id, l.exam_id, l.passage_id, a.stage, concat('sentence:', l.passage_id * 100000 + a.id % 4) as item_key, a.correct, a.stage_item_count, a.created_at from @attempts a join @students s on s.id = a.student_id join @current_exams e on e.school = s.school and e.grade = s.grade join @links l on l.exam_id = e.id and l.position = a.id % 3",
    "claims": "select item_id * 10 + n as claim_id, item_id % 6 as passage_id, item_id as fact_key, text as statement, cast((item_id + n) % 3 + 1 as int) as difficulty, case when n % 2 = 0 then 'ko' else 'en' end as language, case (item_id + n) % 4 when 0 then 'draft' when 1 then 'stale' else 'confirmed' end as status from @benchmark, (values (0), (1), (2)) as t(n)",
    "variants": "select claim_id, concat('v', n) as variant_key, concat(statement, ' v', n) as statement, difficulty, language, case (claim_id + n) % 3 when 0 then 'draft' else 'confirmed' end as status from @claims, (values (1), (2)) as t(n)",
    "lookups": "select conv_id as student_id, turn - turn % 3 as passage_id, turn as id, role as meaning, lower(regexp_extract(text, '[A-Za-z]+', 0)) as word, case when turn % 2 = 0 then lower(regexp_extract(text, '[A-Za-z]+', 0)) when turn % 4 = 1 then '' end as lemma, upper(regexp_extract(text, '[A-Za-z]+', 0)) as form, turn % 3 > 0 as resolved, case when turn % 2 = 0 then 'initial' else 'retry' end as reason, turn as created_at from @conversations",
    "sentences": "select passage_id * 100000 + sentence_index as id, passage_id, sentence_index, text, case when sentence_index % 7 = 0 then '' else text end as translation, case when sentence_index = 0 then 'TITLE' when sentence_index % 9 = 8 then 'SUBTITLE' else 'SENTENCE' end as block_type, sentence_index % 11 <> 10 as active, cast(floor(sentence_index / 5) as int) as paragraph_index from @pieces",
    "edited": "select case when sentence_index % 6 = 5 then null else id end as id, passage_id, row_number() over (partition by passage_id order by sentence_index) - 1 as position, case when sentence_index % 5 = 3 then concat(text, ' edited') else text end as text, translation from @sentences where block_type = 'SENTENCE' and sentence_index % 4 <> 2",
    "attempts": "select event_id as id, user_id as student_id, 1 as exam_id, event_id % 3 as passage_id, concat('sentence:', event_type) as item_key, cast(event_id % 2 + 1 as int) as stage, concat('sentence_order_step', event_id % 2 + 1) as semantic_type, value > 5 as correct, case when event_id % 5 < 2 then 5 else 4 end as stage_item_count, ts as created_at, case when event_id % 13 = 0 then null when event_id % 17 = 0 then 'not-an-id' else concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 14, 3), '-8', substr(h, 18, 3), '-', substr(h, 21, 12)) end as client_attempt_id from (select *, md5(cast(cast(floor(event_id / 2) as bigint) as varchar(20))) as h from @events)",
    "big_attempts": "select l_suppkey as student_id, l_linenumber as passage_id, concat(l_returnflag, l_linestatus) as item_key, cast(l_orderkey % 2 + 1 as int) as stage, l_quantity > 10 as correct, l_shipdate as created_at from @lineitem",
    "requests": "select id as sentence_id, passage_id, text, cast(id % 3 + 1 as int) as step, case when id % 10 = 7 then concat(text, ' extra') when id % 10 = 8 then lower(text) when id % 10 = 6 then replace(text, 'é', 'é') else text end as raw_arranged, cast(id % 4 as int) - case when id % 19 = 0 then 4 else 0 end as mistakes, cast(case when id % 5 < 3 then 0 else id % 3 end as int) as restarts from @sentences",
    "logins": "select event_id as id, event_type as channel, user_id % 40 as identifier, event_type <> 'error' as successful, ts as created_at, user_id % 40 as realm, user_id % 4 = 0 as admin, concat('code', user_id) as code, concat('ip', event_id % 3) as client from @events",
    "sessions": "select user_id * 100 + day as id, user_id, created_at, created_at + interval '12' hour as expires_at, revoked_at from (select user_id, cast(extract(day from ts) as bigint) as day, min(ts) as created_at, min(case when event_type = 'error' then ts end) as revoked_at from @events group by user_id, cast(extract(day from ts) as bigint))",
    "questions": "select p_partkey as id, p_size as passage_id, case when p_partkey % 3 = 0 then 'written_response' when p_partkey % 3 = 1 then 'multiple_choice' else 'essay' end as type, case when p_partkey % 4 = 0 then 'draft' else 'available' end as status, case when p_partkey % 7 = 0 then 3 end as difficulty, concat('{\"exam\":\"', p_brand, '\",\"section\":\"', p_type, '\",\"prompt\":\"', p_name, '\",\"taxonomy\":\"', case p_partkey % 5 when 0 then 'topic' when 1 then 'implication' when 2 then 'grammar' when 3 then 'title' else '' end, '\",\"response_slots\":[{\"word_count\":', p_size, '},{\"word_count\":', p_partkey % 9, '}]}') as payload from @part",
    "question_attempts": "select event_id as id, user_id as student_id, 1 as exam_id, event_id % 50 as question_id, value > 5 as correct, ts as created_at from @events",
    "words": "select conv_id as student_id, turn as passage_id, role as meaning, lower(regexp_extract(text, '[A-Za-z]+', 0)) as word, turn as seen_at from @conversations",
    "facts": "select item_id as fact_key, item_id % 6 as passage_id, text as statement, case item_id % 3 when 0 then 'draft' when 1 then 'confirmed' else 'stale' end as status, cast(item_id % 3 + 1 as int) as difficulty, case when item_id % 4 = 0 then 'ko' else 'en' end as language from @benchmark",
}
SPARK_ONLY = {
    "pieces": "select doc_id as passage_id, pos as sentence_index, text from (select doc_id, posexplode(split(text, '[.] ')) as (pos, text) from @documents)",
    # The rows of the text above, numbered inside their document, so that no text is shuffled for its place.
    "edited": "select case when s.at % 6 = 5 then null else passage_id * 100000 + s.at end as id, passage_id, position, case when s.at % 5 = 3 then concat(s.text, ' edited') else s.text end as text, case when s.at % 7 = 0 then '' else s.text end as translation from (select doc_id as passage_id, posexplode(filter(transform(split(text, '[.] '), (x, i) -> struct(i as at, x as text)), x -> x.at > 0 and x.at % 9 <> 8 and x.at % 4 <> 2)) as (position, s) from @documents)",
}
DUCK_ONLY = {"pieces": "select doc_id as passage_id, generate_subscripts(p, 1) - 1 as sentence_index, unnest(p) as text from (select doc_id, string_split(text, '. ') as p from @documents)"}
NAME = re.compile(r"@([a-z_]+)")


def duck(sql: str) -> str:
    """DuckDB text: frames in place of their names, tables as they are."""

    def put(m: re.Match) -> str:
        name = m[1]
        return name if name in TABLES else f"({duck(DUCK_ONLY.get(name) or FRAMES[name])})"

    return NAME.sub(put, sql)


class Frames:
    """The frames of one folder, read as needed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        plain_unions(spark)
        small_tasks(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            found = self.table(name)
        elif name in FRAMES or name in SPARK_ONLY:
            found = self.sql(SPARK_ONLY.get(name) or FRAMES[name])
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over frames; each @name is one of them."""
        names = sorted(set(NAME.findall(text)))
        return self.spark.sql(NAME.sub(lambda m: "{" + m[1] + "}", text.replace("{", "{{").replace("}", "}}")), **{n: getattr(self, n) for n in names})


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(frames) under a name, with the oracle's text."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add
