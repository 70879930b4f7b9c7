import random

from conftest import rows
from pyspark.sql import functions as F

from carepath.operators import messages
from carepath.operators.scorers import evaluate

SCHEMA = "conv_id int, turn bigint, role string, content string, tool_calls array<struct<name:string,args:map<string,string>>>"


def talk(spark, data):
    return spark.createDataFrame([(c, t, r, x, calls) for c, t, r, x, calls in data], SCHEMA)


def random_talk(n_conversations=4, length=40, seed=3):
    rng = random.Random(seed)
    out = []
    for c in range(n_conversations):
        for t in range(length):
            role = rng.choice(["user", "assistant", "assistant", "assistant", "system"])
            out.append((c, t, role, f"m{c}-{t}", None))
    return out


def test_pairs_across_buckets_equal_brute_force(spark):
    data = random_talk()
    want = []
    for c, t, role, text, _ in data:
        if role == "assistant":
            asked = [x for x in data if x[0] == c and x[1] < t and x[2] == "user"]
            want.append((c, t, asked[-1][1] if asked else None, asked[-1][3] if asked else None, text))
    for bucket in (3, 7, 1000):
        got = rows(messages.request_response_pairs(talk(spark, data), bucket))
        assert got == sorted(want, key=str)


def test_parts_hold_every_message_once_in_order(spark):
    data = random_talk(2, 25)
    frame = talk(spark, data).repartition(4)
    for size, parts in ((10, 6), (1000, 2)):
        built = messages.append_messages(frame, size)
        assert built.count() == parts
        chunks = messages.message_chunks(built).orderBy("conv_id", "chunk_no").collect()
        assert [(r.conv_id, r.chunk_no, r.role, r.delta) for r in chunks] == [(c, t, r, x) for c, t, r, x, _ in data]


def test_system_prompt_comes_first_once(spark):
    built = messages.append_messages(talk(spark, random_talk(1, 25)), 10)
    with_prompt = messages.prepend_system(built, "Be brief.").orderBy("part_no").collect()
    assert [r.messages[0].role == "system" and r.messages[0].content == "Be brief." for r in with_prompt] == [True, False, False]
    assert [r.n_messages for r in with_prompt] == [11, 10, 5]
    assert messages.prepend_system(built, "") is built


def test_tool_calls_of_the_last_message_decide(spark):
    call = [("get_patient_enrollment", {"patient_id": "a"})]
    data = [
        (1, 0, "user", "q", None), (1, 1, "assistant", None, call),
        (2, 0, "assistant", None, call), (2, 1, "assistant", "done", []),
        (3, 0, "user", "q", None),
    ]
    got = rows(messages.tool_call_split(talk(spark, data)).select("conv_id", "next_step"))
    assert got == [(1, "continue"), (2, "end"), (3, "end")]
    empty = messages.append_messages(talk(spark, data).where("conv_id > 9"))
    assert messages.message_chunks(empty).collect() == []


def test_last_user_message_with_content(spark):
    def m(*pairs):
        return [(r, c) for r, c in pairs]

    data = [
        ("plain", m(("user", "where was care given")), "care was given"),
        ("tool last", m(("user", "which payer covered"), ("assistant", "x"), ("tool", "y")), "covered"),
        ("two users", m(("user", "alpha"), ("user", "bravo")), "bravo"),
        ("null last", m(("user", "bravo"), ("user", None)), "bravo"),
        ("empty last", m(("user", "bravo"), ("user", "")), "bravo"),
        ("no user", m(("system", "bravo")), "bravo"),
        ("no list", None, "bravo"),
        ("no answer", m(("user", "bravo")), None),
    ]
    df = spark.createDataFrame(data, "trace_id string, messages array<struct<role:string,content:string>>, response string")
    got = {r.trace_id: (r.value, r.rationale) for r in evaluate(df, ["message_relevance"]).collect()}
    assert got["plain"][0] == 2 / 3 and got["tool last"][0] == 1 / 3
    assert got["two users"][0] == got["null last"][0] == 1.0
    for name in ("empty last", "no user", "no list"):
        assert got[name] == (None, "no user message with words")
    assert got["no answer"][0] == 0.0


def test_a_long_conversation_has_one_prompt_one_id_and_gapless_numbers(spark):
    data = [(1, 3 * t + 5000, "user", f"m{t}", None) for t in range(2500)]
    built = messages.append_messages(talk(spark, data))
    prompted = messages.prepend_system(built, "Be brief.")
    assert sum(m.role == "system" for r in prompted.collect() for m in r.messages) == 1
    numbers = sorted(r.chunk_no for r in messages.message_chunks(prompted).collect())
    assert numbers == list(range(2501))
    assert messages.conversation_ids(built).count() == 1


def test_tool_calls_go_along(spark):
    call = [("get_patient_enrollment", {"patient_id": "a"})]
    (chunk,) = messages.message_chunks(messages.append_messages(talk(spark, [(1, 0, "assistant", None, call)]))).collect()
    assert chunk.tool_calls[0].name == "get_patient_enrollment"


def test_null_and_repeated_turns_are_cut_into_parts(spark):
    data = [(1, None, "user", f"m{k % 700}", None) for k in range(2500)] + [(1, 4, "user", "same", None)] * 2300 + [(None, 0, "user", "x", None)]
    built = messages.append_messages(talk(spark, data).repartition(5)).collect()
    sizes = {(r.conv_id, r.part_no): r.n_messages for r in built}
    assert sizes == {(1, 0): 1000, (1, 1): 1000, (1, 2): 1000, (1, 3): 1000, (1, 4): 800, (None, 0): 1}
    texts = [m.content for r in sorted((r for r in built if r.conv_id), key=lambda r: r.part_no) for m in r.messages]
    assert sorted(texts[:2500]) == sorted(x[3] for x in data[:2500]) and set(texts[2500:]) == {"same"}


def test_no_window_and_no_unbounded_list_sees_a_text(spark):
    built = messages.append_messages(talk(spark, random_talk(2, 30)), 10)
    for df in (built, messages.prepend_system(built, "Be brief."), messages.message_chunks(built)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window [" in line]
        assert all("messages" not in line and "content" not in line for line in windows)
        below = plan.split("Window [")[1:]
        assert all("content" not in part.split("Join")[0] for part in below)


def test_a_conversation_with_a_third_of_all_messages(spark):
    data = [(1, t, "user", f"a{t}", None) for t in range(4000)] + [(c, t, "user", f"b{t}", None) for c in range(2, 802) for t in range(10)]
    built = messages.append_messages(talk(spark, data).repartition(6))
    prompted = messages.prepend_system(built, "Be brief.")
    chunks = messages.message_chunks(prompted).collect()
    assert len(chunks) == len(data) + 801
    hot = sorted((r.chunk_no, r.delta) for r in chunks if r.conv_id == 1)
    assert hot == [(0, "Be brief."), *((t + 1, f"a{t}") for t in range(4000))]
