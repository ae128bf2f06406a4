"""Queries of grading, folds, logs, content and banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonloom.functions import text as T
from lessonloom.operators import content as K
from lessonloom.operators import lexical as L
from lessonloom.operators import practice as P
from lessonloom.operators import tables as O
from lessonloom.plans.frames import query
from lessonloom.plans.texts import WORDS

ARRANGED = f"select *, array_to_string({WORDS.replace('text', 'raw_arranged')}, ' ') as arranged, {WORDS} as w from @requests"
NORMAL = "translate(lower(nfc_normalize({})), '‐‑‒–—−', '------')"
REASON = f"""case when step not in (1, 2) then 'unknown_step' when len(w) < 2 then 'not_orderable' when mistakes not between 0 and 999 or restarts not between 0 and 999 then 'invalid_counter'
 when {NORMAL.format("array_to_string(w, ' ')")} <> {NORMAL.format("arranged")} then 'incomplete_sentence' when step = 1 and restarts <> 0 then 'step1_never_restarts'
 when step = 2 and mistakes - restarts * (case when len(w) >= 12 then 2 else 1 end) not between 0 and (case when len(w) >= 12 then 1 else 0 end) then 'step2_counts_inconsistent' end"""
CLEAN_RUN = "case when step = 1 then mistakes = 0 else restarts = 0 end"


def arranged(rows):
    return rows.withColumn("arranged", F.array_join(T.sentence_words(F.col("raw_arranged")), " "))


@query("i1_grade_attempts", f"select sentence_id, len(w) as word_count, reason, case when reason is null then {CLEAN_RUN} end as correct from (select *, {REASON} as reason from ({ARRANGED}))")
def _(f):
    return P.grade_attempts(arranged(f.requests)).select("sentence_id", F.col("word_count").cast("long").alias("word_count"), "reason", "correct")


#: Each attempt names a sentence of the passage that its number falls on; some name one that is not there.
BATCH = "select a.id, a.student_id, a.client_attempt_id, a.passage_id, a.sentence_id, coalesce(r.step, 1) as step, coalesce(r.mistakes, 0) as mistakes, coalesce(r.restarts, 0) as restarts, r.raw_arranged from (select id, student_id, client_attempt_id, id % n as passage_id, (id % n) * 100000 + cast(floor(id / n) as bigint) % 7 as sentence_id from @attempts cross join (select count(*) as n from @documents)) a left join @requests r on r.sentence_id = a.sentence_id"
STORED = "select student_id, client_attempt_id, min(id) as first_id from @attempts where id % 7 = 0 and client_attempt_id is not null group by 1, 2"
GOOD_ID = "coalesce(regexp_matches(lower(client_attempt_id), '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'), false)"
ITEMS = f"select id, passage_id, sentence_index, text, w from (select *, {WORDS} as w from @sentences where active and block_type = 'SENTENCE' and trim(translation) <> '') where len(w) >= 2"


@query(
    "i2_submit_attempts",
    f"""with i as ({ITEMS}), c as (select passage_id, count(*) as items from i group by 1),
 g as (select b.*, {GOOD_ID.replace('client', 'b.client')} as good, array_to_string({WORDS.replace('text', 'raw_arranged')}, ' ') as arranged, i.w, s.first_id is not null as known from ({BATCH}) b left join i on i.id = b.sentence_id left join ({STORED}) s on s.student_id = b.student_id and s.client_attempt_id = b.client_attempt_id),
 j as (select *, case when not good then 'invalid_id' when known then null when passage_id % 9 = 0 then 'not_in_scope' when w is null then 'not_orderable_now' else {REASON} end as refused from g),
 o as (select *, case when not good then 'rejected' when known then 'replayed' when refused is not null then 'rejected' when id = min(case when refused is null then id end) over (partition by student_id, case when good then client_attempt_id else cast(id as varchar) end) then 'stored' else 'replayed' end as outcome from j)
 select id, outcome, case when outcome = 'rejected' then refused end as reason, case when outcome = 'stored' then arranged end as arranged, case when outcome = 'stored' then len(w) end as word_count, case when outcome = 'stored' then passage_id % 5 end as passage_revision, case when outcome = 'stored' then items end as stage_item_count, case when outcome = 'rejected' then null when known then true else {CLEAN_RUN} end as correct from o left join c using (passage_id)""",
)
def _(f):
    batch = arranged(f.sql(BATCH))
    # Grading cleans the texts that it splits; those of sentences that nobody tries stay as they are.
    items = P.orderable(f.sentences).select(F.col("id").alias("sentence_id"), "passage_id", "text")
    stored = f.sql(STORED).withColumn("stored_correct", F.lit(True))
    passages = f.documents.select(F.col("doc_id").alias("passage_id"), (F.col("doc_id") % 5).alias("revision"))
    done = P.submit_attempts(batch, stored, batch.where("passage_id % 9 <> 0").select("student_id", "passage_id"), items, passages)
    correct = F.when((F.col("outcome") != "rejected"), F.col("correct"))
    return done.select("id", "outcome", "reason", "response.arranged", F.col("response.word_count").cast("long").alias("word_count"), "passage_revision", "stage_item_count", correct.alias("correct"))


I3_WORDS = f"(select id, {WORDS} as w from @sentences)"
WORD = NORMAL.format("unnest(w)")


@query("i3_answer_indexes", f"with a as (select id, place, word, row_number() over (partition by id, word order by place) as turn from (select id, generate_subscripts(w, 1) - 1 as place, {WORD} as word from {I3_WORDS})), c as (select id, place, word, row_number() over (partition by id, word order by place) as turn from (select id, len(w) - generate_subscripts(w, 1) as place, {WORD} as word from {I3_WORDS})) select a.id, string_agg(cast(c.place as varchar), ',' order by a.place) as indexes from a join c on c.id = a.id and c.word = a.word and c.turn = a.turn group by a.id")
def _(f):
    rows = f.sentences.select("id", T.sentence_words(F.col("text")).alias("answer"), "text").where(T.has_word(F.col("text"))).withColumn("chips", F.reverse("answer"))
    return P.answer_indexes(rows, "id", "chips", "answer").select("id", F.array_join(F.col("indexes").cast("array<string>"), ",").alias("indexes"))


@query("i4_attempt_payload", f"select id as sentence_id, step, array_to_string(list_reverse(w), ' ') as arranged, mistakes, restarts, {CLEAN_RUN} as clean from (select id, {WORDS} as w, cast(id % 2 + 1 as int) as step, cast(id % 3 as int) as mistakes, cast(id % 5 as int) as restarts from @sentences)")
def _(f):
    i = F.col("id")
    rows = f.sentences.select(i.alias("sentence_id"), T.sentence_words(F.col("text")).alias("words"), (i % 2 + 1).cast("int").alias("step"), (i % 3).cast("int").alias("mistakes"), (i % 5).cast("int").alias("restarts"))
    chosen = F.reverse(F.filter(F.sequence(F.lit(0), F.size("words")), lambda k: k < F.size("words")))
    return P.attempt_payload(rows.withColumn("chosen", chosen)).withColumn("clean", P.run_is_clean(F.col("step"), F.col("mistakes"), F.col("restarts")))


@query("i5_chip_bank", f"select id, array_to_string(case when len(mixed) > 1 and mixed = plain then list_append(plain[2:], 0) else mixed end, ',') as bank from (select id, list(i order by md5(concat_ws(':', '7', cast(id as varchar), cast(i as varchar))), i) as mixed, list(i order by i) as plain from (select id, unnest(range(len(w))) as i from ({ITEMS})) group by 1)")
def _(f):
    return P.chip_bank(P.practice_items(f.sentences), seed=7).select("id", F.array_join(F.col("bank").cast("array<string>"), ",").alias("bank"))


@query("i6_chip_batches", f"select id, b as batch, array_to_string(w[b * 4 + 1 : b * 4 + 4], ' ') as chips from (select id, w, unnest(range(0, cast(greatest(ceil(len(w) / 4.0), 1) as bigint))) as b from (select id, {WORDS} as w from @sentences))")
def _(f):
    rows = f.sentences.select("id", T.sentence_words(F.col("text")).alias("words"))
    return P.chip_batches(rows, "id", "words").select("id", F.col("batch").cast("long").alias("batch"), F.array_join("chips", " ").alias("chips"))


# --- folds ------------------------------------------------------------------------

FOLD = """with recursive a as (select student_id, passage_id, stage, item_key, stage_item_count as n, created_at, row_number() over (partition by student_id, passage_id, stage order by created_at, id) as rn from {source} where correct and stage_item_count > 0),
 r as (select student_id, passage_id, stage, rn, case when n <= 1 then 1 else 0 end as completed, case when n <= 1 then cast([] as varchar[]) else [item_key] end as clears, case when n <= 1 then n else 1 end as correct_clears, created_at as updated_at from a where rn = 1
 union all select a.student_id, a.passage_id, a.stage, a.rn, case when list_contains(r.clears, a.item_key) then r.completed when len(r.clears) + 1 >= a.n then r.completed + 1 else r.completed end,
 case when list_contains(r.clears, a.item_key) then r.clears when len(r.clears) + 1 >= a.n then cast([] as varchar[]) else list_append(r.clears, a.item_key) end,
 case when list_contains(r.clears, a.item_key) then r.correct_clears when len(r.clears) + 1 >= a.n then (r.completed + 1) * a.n else r.completed * a.n + len(r.clears) + 1 end,
 case when list_contains(r.clears, a.item_key) then r.updated_at else a.created_at end
 from r join a on a.student_id = r.student_id and a.passage_id = r.passage_id and a.stage = r.stage and a.rn = r.rn + 1),
 f as (select * from r qualify row_number() over (partition by student_id, passage_id, stage order by rn desc) = 1)"""


@query("j1_dedup_attempts", "select id from (select *, row_number() over (partition by student_id, client_attempt_id order by created_at, id) as rn from @attempts) where client_attempt_id is null or rn = 1")
def _(f):
    return P.first_per_key(f.attempts, ["student_id", "client_attempt_id"], ["created_at", "id"]).select("id")


@query("j2_cycle_progress", FOLD.format(source="@attempts") + " select student_id, passage_id, stage, completed, completed + 1 as current_cycle, array_to_string(list_sort(clears), ',') as clears, correct_clears, updated_at from f")
def _(f):
    return P.cycle_progress(f.attempts, P.STEP_KEY).drop("semantic_type").withColumn("clears", F.array_join("clears", ","))


#: Attempts of several exams, workbooks, contracts and types, some of them empty or missing.
FULL_KEY = ["student_id", "exam_id", "passage_id", "workbook_key", "stage_contract_version", "progress_key"]
KEYED = "select id, student_id % 7 as student_id, passage_id % 2 as exam_id, passage_id, case when id % 4 = 0 then 'chips' else 'sentence-practice' end as workbook_key, case id % 3 when 0 then '' when 1 then null else 'v2' end as stage_contract_version, case when id % 5 = 0 then '' when id % 5 > 2 then semantic_type end as semantic_type, stage, item_key, correct, cast(id % 2 + 2 as int) as stage_item_count, created_at from @attempts"
NAMED = f"(select *, coalesce(nullif(stage_contract_version, ''), 'legacy-v1') as contract, coalesce(nullif(semantic_type, ''), concat('stage:', stage)) as progress_key from ({KEYED}))"
_SAME = " and ".join(f"a.{k} = r.{k}" for k in [*FULL_KEY[:4], "contract", "progress_key"])
_KEYS = "student_id, exam_id, passage_id, workbook_key, contract, progress_key"


@query(
    "j2_cycle_progress_full",
    f"""with recursive a as (select {_KEYS}, stage, nullif(semantic_type, '') as semantic_type, item_key, stage_item_count as n, created_at, row_number() over (partition by {_KEYS} order by created_at, id) as rn from {NAMED} where correct and stage_item_count > 0),
 r as (select {_KEYS}, 0::bigint as rn, 0 as completed, cast([] as varchar[]) as clears, 0 as correct_clears, null::int as stage, null::varchar as semantic_type, null::timestamp as updated_at from a where rn = 1
 union all select {_KEYS}, rn, case when again then completed when closed then completed + 1 else completed end, case when again then clears when closed then cast([] as varchar[]) else u end, case when again then correct_clears when closed then (completed + 1) * n else completed * n + len(u) end, case when again then old_stage else stage end, case when again then old_type else semantic_type end, case when again then updated_at else created_at end
 from (select *, len(u) >= n as closed from (select {', '.join(f'a.{k.strip()}' for k in _KEYS.split(','))}, a.rn, a.n, a.stage, a.semantic_type, a.created_at, r.completed, r.clears, r.correct_clears, r.stage as old_stage, r.semantic_type as old_type, r.updated_at, list_contains(r.clears, a.item_key) as again, list_append(r.clears, a.item_key) as u from r join a on a.rn = r.rn + 1 and {_SAME})))
 select student_id, exam_id, passage_id, workbook_key, contract as stage_contract_version, progress_key, completed, completed + 1 as current_cycle, array_to_string(list_sort(clears), ',') as clears, correct_clears, stage, semantic_type, updated_at from r qualify row_number() over (partition by {_KEYS} order by rn desc) = 1""",
)
def _(f):
    return P.cycle_progress(f.sql(KEYED)).withColumn("clears", F.array_join("clears", ","))


#: Items that are still there, for the keys of two students of three; for the others all count.
ACTIVE = "case when student_id % 3 > 0 then ['sentence:view', 'sentence:click', 'sentence:error', 'sentence:purchase'] end"


@query(
    "j2_cycle_progress_active",
    f"""with recursive a as (select student_id, passage_id, stage, item_key, stage_item_count as n, {ACTIVE} as act, created_at, row_number() over (partition by student_id, passage_id, stage order by created_at, id) as rn from @attempts where correct and stage_item_count > 0),
 r as (select student_id, passage_id, stage, 0::bigint as rn, 0 as completed, cast([] as varchar[]) as clears, 0 as correct_clears, null::timestamp as updated_at from a where rn = 1
 union all select student_id, passage_id, stage, rn, case when skip then completed when closed then completed + 1 else completed end, case when skip then b when closed then cast([] as varchar[]) else u end, case when skip then correct_clears when closed then (completed + 1) * n else completed * n + len(u) end, case when skip then updated_at else created_at end
 from (select *, len(u) >= n as closed, repeated and not (len(u) >= n and act is not null) as skip from (select *, case when repeated then b else list_append(b, item_key) end as u from (select *, list_contains(b, item_key) as repeated from (select a.*, r.completed, r.correct_clears, r.updated_at, case when act is null then r.clears else list_filter(r.clears, lambda x: list_contains(a.act, x)) end as b from r join a on a.student_id = r.student_id and a.passage_id = r.passage_id and a.stage = r.stage and a.rn = r.rn + 1)))))
 select student_id, passage_id, stage, completed, completed + 1 as current_cycle, array_to_string(list_sort(clears), ',') as clears, correct_clears, updated_at from r qualify row_number() over (partition by student_id, passage_id, stage order by rn desc) = 1""",
)
def _(f):
    items = F.array(*[F.lit(f"sentence:{x}") for x in ("view", "click", "error", "purchase")])
    active = f.attempts.where("student_id % 3 > 0").select(*P.STEP_KEY).distinct().withColumn("active_items", items)
    return P.cycle_progress(f.attempts, P.STEP_KEY, active=active).drop("semantic_type").withColumn("clears", F.array_join("clears", ","))


#: Catalogs of a passage as they were published over time: items of a set, by what was sold.
CATALOG_LOG = "select event_id as catalog_id, event_id % 3 as passage_id, cast(user_id % 5 as int) as items, ts as updated_at from @events where event_type = 'signup'"
LATEST = f"(select passage_id, items from ({CATALOG_LOG}) qualify row_number() over (partition by passage_id order by updated_at desc, catalog_id desc) = 1)"


@query("j3_rebuild_progress", FOLD.format(source=f"(select a.id, a.student_id, a.passage_id, a.stage, a.item_key, a.correct, a.created_at, c.items as stage_item_count from @attempts a join {LATEST} c on c.passage_id = a.passage_id and c.items > 0)") + " select student_id, passage_id, stage, completed, correct_clears from f")
def _(f):
    return P.rebuild_progress(f.attempts, f.sql(CATALOG_LOG), P.STEP_KEY).select("student_id", "passage_id", "stage", "completed", "correct_clears")


@query("c6_practice_progress", FOLD.format(source="@attempts") + ", i as (select distinct passage_id, item_key from @attempts where item_key <> 'sentence:error') select g.student_id, g.passage_id, g.stage, (select count(*) from i where i.passage_id = g.passage_id) as total, coalesce(f.correct_clears, 0) as correct_clears, coalesce(f.completed, 0) as completed, coalesce(len(list_filter(f.clears, lambda x: x <> 'sentence:error')), 0) as open_clears, cast(floor(coalesce(f.correct_clears, 0) * 100 / (select count(*) from i where i.passage_id = g.passage_id)) as bigint) as percent from (select s.id as student_id, p as passage_id, k as stage from @students s, (values (0), (1), (2)) as t(p), (values (1), (2)) as u(k)) g left join f on f.student_id = g.student_id and f.passage_id = g.passage_id and f.stage = g.stage")
def _(f):
    steps = f.spark.range(0, 3).select(F.col("id").alias("passage_id")).crossJoin(f.spark.range(1, 3).select(F.col("id").cast("int").alias("stage")))
    grid = f.students.select(F.col("id").alias("student_id")).crossJoin(F.broadcast(steps))
    items = f.attempts.where("item_key <> 'sentence:error'").select("passage_id", "item_key").distinct()
    return P.practice_progress(grid, P.cycle_progress(f.attempts, P.STEP_KEY), items)


#: Items of a passage in an order of their own, one of them gone.
PLACED = "select passage_id, item_key, length(item_key) as sentence_index from (select distinct passage_id, item_key from @attempts where item_key <> 'sentence:error')"


@query("f3_first_open_of_student", FOLD.format(source="@attempts") + f", i as (select passage_id, item_key, row_number() over (partition by passage_id order by sentence_index, item_key) - 1 as place from ({PLACED})), h as (select distinct student_id, passage_id, stage from @attempts) select student_id, passage_id, stage, item_key, place from (select h.*, i.item_key, i.place, coalesce(list_contains(f.clears, i.item_key), false) as cleared from h join i using (passage_id) left join f using (student_id, passage_id, stage)) qualify row_number() over (partition by student_id, passage_id, stage order by cleared, place) = 1")
def _(f):
    homes = f.attempts.select(*P.STEP_KEY).distinct()
    return P.first_open_item(homes, f.sql(PLACED), P.cycle_progress(f.attempts, P.STEP_KEY))


CAT, LONG_CAT = "the cat saw the dog run", "on Monday the old cat saw the dog run to the Café"
TAPS = "select user_id as run_id, event_id as seq, case when event_id % 4 < 3 then cast(floor(event_id / 150) as bigint) % 12 else event_id % 14 - 1 end as chip from @events"


@query(
    "j4_replay_taps",
    f"""with recursive w as (select run_id, string_split(case when run_id % 2 = 0 then '{CAT}' else lower('{LONG_CAT}') end, ' ') as norm, case when run_id % 2 = 0 then 0 else 1 end as allowance from (select distinct user_id as run_id from events)),
 t as (select t.*, w.norm, w.allowance, row_number() over (partition by run_id order by seq) as rn from ({TAPS}) t join w using (run_id)),
 r as (select run_id, 0::bigint as rn, cast([] as bigint[]) as used, 0 as slips, 0 as mistakes, 0 as restarts from t where rn = 1
 union all select run_id, rn, case when ignored then used when good then list_append(used, chip) when slips + 1 > allowance then cast([] as bigint[]) else used end, case when ignored or good then slips when slips + 1 > allowance then 0 else slips + 1 end, case when ignored or good then mistakes else mistakes + 1 end, case when ignored or good or slips + 1 <= allowance then restarts else restarts + 1 end
 from (select t.*, r.used, r.slips, r.mistakes, r.restarts, len(r.used) >= len(t.norm) or t.chip < 0 or t.chip >= len(t.norm) or list_contains(r.used, t.chip) as ignored, t.norm[t.chip + 1] = t.norm[len(r.used) + 1] as good from r join t on t.run_id = r.run_id and t.rn = r.rn + 1))
 select run_id, len(used)::int as placed, mistakes, restarts, len(used) >= len(norm) as completed, len(used) >= len(norm) and restarts = 0 as clean from r join w using (run_id) qualify row_number() over (partition by run_id order by rn desc) = 1""",
)
def _(f):
    sentence = F.when(F.col("run_id") % 2 == 0, CAT).otherwise(LONG_CAT.replace("é", "e\u0301"))
    words = f.events.select(F.col("user_id").alias("run_id")).distinct().withColumn("words", F.split(sentence, " "))
    return P.replay_taps(f.sql(TAPS), words, step=2)


#: Lower limits and a longer window than in earnest, so that the tables' tries meet them.
LIMITS, DAY, WINDOW = {"code": 2, "student_client": 4, "admin_client": 2, "admin": 3}, 24 * 60, 7 * 24 * 60
LOCK = f"""with recursive t as (select id, realm, successful, epoch_us(created_at) as us, case when admin then 'admin_client' else 'student_client' end as kind1, case when admin then {LIMITS["admin_client"]} else {LIMITS["student_client"]} end as most1, case when admin then 'admin' else 'code' end as kind2, case when admin then {LIMITS["admin"]} else {LIMITS["code"]} end as most2, concat(admin, client) as who1, case when admin then 'admin' else code end as who2, row_number() over (partition by realm order by epoch_us(created_at), id) as rn from @logins),
 r as (select realm, 0::bigint as rn, null::bigint as id, null::varchar as blocked_by, cast([] as struct(who varchar, us bigint)[]) as failed from t where rn = 1
 union all select realm, rn, id, blocked_by, case when blocked_by is null and not successful then list_concat(recent, [{{'who': who1, 'us': us}}, {{'who': who2, 'us': us}}]) else recent end
 from (select *, case when len(list_filter(recent, lambda x: x.who = who1)) >= most1 then kind1 when len(list_filter(recent, lambda x: x.who = who2)) >= most2 then kind2 end as blocked_by from (select t.*, list_filter(r.failed, lambda x: x.us >= t.us - {WINDOW * 60_000_000}) as recent from r join t on t.realm = r.realm and t.rn = r.rn + 1)))"""


@query("j5_login_lockout", LOCK + " select realm, id, blocked_by from r where blocked_by is not null")
def _(f):
    return P.login_lockout(f.logins.withColumn("at_us", F.unix_micros(F.col("created_at").cast("timestamp"))), LIMITS, WINDOW, key="realm")


@query("j5_login_lockout_global", LOCK.replace(str(WINDOW * 60_000_000), str(DAY * 60_000_000)).replace("partition by realm", "partition by 1").replace("realm, successful", "0 as realm, successful") + " select id, blocked_by from r where blocked_by is not null")
def _(f):
    return P.login_lockout(f.logins.withColumn("at_us", F.unix_micros(F.col("created_at").cast("timestamp"))), LIMITS, DAY)


THIN = """with recursive t as (select user_id as session_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from @events),
 r as (select session_id, rn, us as at_us, us as last, true as kept from t where rn = 1
 union all select t.session_id, t.rn, t.us, case when t.us > r.last + 36000000000 then t.us else r.last end, t.us > r.last + 36000000000 from r join t on t.session_id = r.session_id and t.rn = r.rn + 1)"""


@query("j6_thin_touches", THIN + " select session_id, at_us from r where kept")
def _(f):
    touches = f.events.select(F.col("user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.lit(None).cast("long").alias("started_us"))
    return P.thin_touches(touches, minutes=600)


ENDINGS = {
    "logouts": "select user_id * 100 + cast(extract(day from ts) as bigint) as session_id, ts as happened_at from @events where event_type = 'error'",
    "code_changes": "select user_id as student_id, ts as happened_at from @events where event_type = 'purchase' and event_id % 3 = 0",
    "deactivations": "select user_id as student_id, ts as happened_at from @events where event_id % 101 = 0",
}
FIRST_END = "(select min(happened_at) from ({}) e where e.{} = s.{} and e.happened_at >= s.created_at) as {}"


@query(
    "j7_session_intervals",
    f"select id, student_id, created_at, ended_at, case when logout = ended_at then 'logout' when code_change = ended_at then 'code_change' when deactivated = ended_at then 'deactivated' else 'expiry' end as reason from (select *, least(expires_at, coalesce(logout, expires_at), coalesce(code_change, expires_at), coalesce(deactivated, expires_at)) as ended_at from (select s.id, s.user_id as student_id, s.created_at, s.expires_at, {FIRST_END.format(ENDINGS['logouts'], 'session_id', 'id', 'logout')}, {FIRST_END.format(ENDINGS['code_changes'], 'student_id', 'user_id', 'code_change')}, {FIRST_END.format(ENDINGS['deactivations'], 'student_id', 'user_id', 'deactivated')} from @sessions s))",
)
def _(f):
    return P.session_intervals(f.sessions.withColumnRenamed("user_id", "student_id"), *[f.sql(q) for q in ENDINGS.values()])


@query("j8_cumulative_clears", "select student_id, passage_id, stage, count(*) as clears, max(created_at) as updated_at from @attempts where correct group by 1, 2, 3")
def _(f):
    from lessonloom.streaming.jobs import cumulative_clears

    return cumulative_clears(f.attempts)


@query("j9_period_summary", "select student_id, stage, day, count(*) as total, count(*) filter (where correct) as clean from (select *, time_bucket(interval '1 day', created_at, timestamp '2023-12-31 15:00:00') as day from @attempts) group by 1, 2, 3")
def _(f):
    from lessonloom.streaming.jobs import period_summary

    return period_summary(f.attempts).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("j10_failed_logins", "select identifier, w as window_start, count(*) as failures from (select identifier, unnest(generate_series(date_trunc('minute', created_at) - interval '14' minute, date_trunc('minute', created_at), interval '1' minute)) as w from @logins where not successful) group by 1, 2")
def _(f):
    from lessonloom.streaming.jobs import failed_logins

    return failed_logins(f.logins).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("j11_word_changelog", "select w.student_id, w.word, w.seen_at from @words w left join (select student_id, word, max(seen_at) as known_at from @words where seen_at % 2 = 0 group by 1, 2) k using (student_id, word) where k.known_at is null or w.seen_at > k.known_at")
def _(f):
    events = f.words.select("student_id", "word", (F.col("seen_at") % 2 == 0).alias("known"), "seen_at")
    saved = f.words.select("student_id", "word", F.col("seen_at").alias("saved_at"))
    return K.word_changelog(events, saved)[1].withColumnRenamed("saved_at", "seen_at")


TEST_SCOPES, TEST_GRADES = "select id, grade from @current_exams where school in ('NATION_1', 'NATION_2')", ["BUILDING", "MACHINERY", "HOUSEHOLD"]


@query("j12_sync_grade_scope", f"with t as (select * from ({TEST_SCOPES}) where grade in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')), k as (select l.exam_id, l.passage_id, row_number() over (partition by l.exam_id order by l.position, l.passage_id) - 1 as position from @links l join t on t.id = l.exam_id join @graded_passages p on p.id = l.passage_id where p.grade = t.grade), n as (select t.id as exam_id, p.id as passage_id from t join @graded_passages p using (grade) where not exists (select 1 from k where k.exam_id = t.id and k.passage_id = p.id)) select * from k union all select n.exam_id, n.passage_id, coalesce((select max(position) from k where k.exam_id = n.exam_id), -1) + row_number() over (partition by n.exam_id order by n.passage_id) from n")
def _(f):
    return O.sync_grade_scope(f.links, f.sql(TEST_SCOPES), f.graded_passages, TEST_GRADES)[0].select("exam_id", "passage_id", "position")


@query("j12_missing_scopes", f"select distinct grade from @graded_passages where grade not in (select grade from ({TEST_SCOPES}) where id % 2 = 0)")
def _(f):
    grades = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return O.sync_grade_scope(f.links, f.sql(TEST_SCOPES).where("id % 2 = 0"), f.graded_passages, grades)[1]


@query("j13_propagate_updated_at", "select e.id, greatest(e.updated_at, coalesce(max(l.l_shipdate), e.updated_at)) as updated_at from @exams e left join lineitem l on l.l_orderkey = e.id group by e.id, e.updated_at")
def _(f):
    children = f.lineitem.select("l_orderkey", F.col("l_shipdate").alias("updated_at"))
    return K.propagate_updated_at(f.exams.select("id", "updated_at"), children, "l_orderkey")


# --- versioned content ------------------------------------------------------------

PREVIOUS = "select passage_id, row_number() over (partition by passage_id order by sentence_index) - 1 as position, id, text from @sentences where block_type = 'SENTENCE'"
FLAT2 = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "c13_match_editor_rows",
    f"""with p as (select *, {FLAT2} as flat from ({PREVIOUS})), n as (select *, {FLAT2} as flat, row_number() over (partition by passage_id, {FLAT2} order by position) as turn from @edited),
 s as (select * from p qualify row_number() over (partition by passage_id, flat order by position) = 1),
 a as (select n.passage_id, n.position, s.id as text_id, s.position as text_at from n left join s on n.turn = 1 and s.passage_id = n.passage_id and s.flat = n.flat)
 select a.passage_id, a.position, coalesce(a.text_id, case when not exists (select 1 from a b where b.passage_id = a.passage_id and b.text_at = a.position) then p.id end) as matched_id from a left join p on p.passage_id = a.passage_id and p.position = a.position""",
)
def _(f):
    return K.match_editor_rows(f.sql(PREVIOUS), f.edited)


STRUCTURE = """with c as (select *, block_type = 'SENTENCE' as sent, exists (select 1 from {edited} e where e.id = s.id) as kept from {current} s),
 w as (select *, first_value(case when sent and kept then id end ignore nulls) over (partition by passage_id order by sentence_index rows between 1 following and unbounded following) as anchor, coalesce(bool_or(sent) over (partition by passage_id order by sentence_index rows between unbounded preceding and 1 preceding), false) as seen from c),
 u as (select w.passage_id, w.id, w.block_type, w.paragraph_index, null as edit_position, case when not seen then 0 when e.position is not null then 1 else 2 end as zone, case when seen then coalesce(e.position, -1) else -1 end as spot, 0 as own, w.sentence_index from w left join {edited} e on e.id = w.anchor where not sent
 union all select e.passage_id, e.id, 'SENTENCE', c.paragraph_index, e.position, 1, e.position, 1, 0 from {edited} e left join c on c.id = e.id)
 select passage_id, row_number() over o - 1 as place, id, block_type, coalesce(last_value(paragraph_index ignore nulls) over (o rows between unbounded preceding and current row), 0) as paragraph_index, edit_position as position from u window o as (partition by passage_id order by zone, spot, own, sentence_index)"""


@query("e9_merge_structure", STRUCTURE.format(current="@sentences", edited="@edited"))
def _(f):
    return K.merge_structure(f.sentences, f.edited)


@query("g5_revision_diff", "select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'deactivated' when a.text = b.text then 'kept' else 'edited' end as change from (select id, text from @sentences where block_type = 'SENTENCE') a full join (select coalesce(id, -(passage_id * 100000 + position)) as id, text from @edited) b on a.id = b.id")
def _(f):
    following = f.edited.select(F.coalesce("id", -(F.col("passage_id") * 100000 + F.col("position"))).alias("id"), "text")
    return K.revision_diff(f.sentences.where("block_type = 'SENTENCE'"), following)


@query("k13_saved_senses", "select student_id, word, meaning as meaning_key, min(seen_at) as first_at from @words where trim(meaning) <> '' group by 1, 2, 3")
def _(f):
    return L.saved_word_senses(f.words, ["student_id", "word"], ["seen_at", "passage_id"]).select("student_id", "word", "meaning_key", F.col("seen_at").alias("first_at"))


#: Attempts as they arrive: some twice, some days after they were made.
DELIVERIES = "select *, created_at + interval '3' day * (id % 3) + interval '1' hour * n as arrived_at from @attempts, (values (0), (1)) as t(n) where n = 0 or id % 4 = 0"


@query("j14_store_and_forward", f"select id, cast(floor((row_number() over (partition by student_id order by arrived_at, id) - 1) / 20) as bigint) as batch, case when {GOOD_ID} then 'stored' else 'rejected' end as outcome from (select * from ({DELIVERIES}) qualify row_number() over (partition by student_id, coalesce(lower(client_attempt_id), concat('row:', id)) order by arrived_at, id) = 1)")
def _(f):
    from lessonloom.operators.rules import is_attempt_id
    from lessonloom.streaming.jobs import forwarded

    judge = lambda df: df.withColumn("outcome", F.when(is_attempt_id(F.col("client_attempt_id")), "stored").otherwise("rejected"))
    return forwarded(f.sql(DELIVERIES), judge).select("id", "batch", "outcome")
