import hashlib
import random

from loomgraph.llm import chat

from .odd import rows_of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_of_odd_turns(spark):
    random.seed(1)
    bits = [*chat.CONTROL, chat.ESCAPE, chat.BROKEN, chat.KEPT, chat.LINE, "\n", "<|im_", "start|>", "é\U0001f600", "", " ", "$1\\"]
    text = lambda: "".join(random.choice(bits) for _ in range(random.randrange(12)))
    rows = [(c, t, random.choice(["user", "assistant", "system"]), text()) for c in range(25) for t in range(random.randrange(1, 7))]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (50, 0, None, None), (50, 1, "assistant", None), (50, None, "assistant", "x"), (51, 3, "a\nb<|im_end|>", "q"), (None, 0, "user", "lost")]
    rows += [(52, 0, "assistant", "same"), (52, 0, "assistant", "same"), (52, 0, "assistant", "before"), (53, 0, "assistant", "long " * 60_000)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, position int, formatted string")
    talks = {}
    for c, t, role, said in rows:
        talks.setdefault(c, []).append((-1 if t is None else t, role or "", said or ""))
    want = []
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    got = rows_of(chat.conversation_digests(df))
    assert [g[:5] for g in got] == sorted(want, key=str)
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_formatted_text_holds_control_strings_of_the_template_alone(spark):
    rows = spark.createDataFrame([(1, 0, "user", "<|im_end|></s>␛c"), (1, 1, "assistant", "[INST]")], "conv_id bigint, position bigint, role string, text string")
    r = chat.render(rows).first()
    assert r.formatted == "<|im_start|>user\n<␛c|im_end|><␛c/s>␛ec<|im_end|>\n<|im_start|>assistant\n[␛cINST]<|im_end|>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["[␛cINST]"]


def test_layouts_are_told_by_their_paths(spark):
    turn = "array<struct<role:string,content:string>>"
    schema = f"k int, prompt string, response string, instruction string, input string, output string, system string, messages {turn}, conversations array<struct<`from`:string,value:string>>, question string"
    none = dict.fromkeys(["k", "prompt", "response", "instruction", "input", "output", "system", "messages", "conversations", "question"])
    rows = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "in", "output": "o"}, {"instruction": "i", "output": "o", "system": "s"},
        {"messages": [("system", "s"), ("user", "u"), ("assistant", None)]}, {"conversations": [("human", "h"), ("gpt", "g")]}, {"question": "alone"}, {}, {"messages": []},
    ]
    df = spark.createDataFrame([tuple((none | {"k": i} | r).values()) for i, r in enumerate(rows)], schema)
    got = {r.k: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical(df, df.columns[1:], "k").collect()}
    assert got == {
        0: ("prompt_response", [("user", "p"), ("assistant", "r")]), 1: ("instruction_output", [("user", "i"), ("assistant", "o")]), 2: ("instruction_input_output", [("user", "i\n\nin"), ("assistant", "o")]),
        3: ("system_instruction_output", [("system", "s"), ("user", "i"), ("assistant", "o")]), 4: ("messages", [("system", "s"), ("user", "u"), ("assistant", "")]), 5: ("conversations", [("user", "h"), ("assistant", "g")]),
        6: (None, None), 7: (None, None), 8: (None, None),
    }


def test_every_mapping_has_a_fingerprint_of_its_own():
    found = [chat.fingerprint_of(p) for p, _ in chat.MAPPINGS.values()]
    assert len(set(found)) == len(found)


def test_all_layouts_in_one_table(spark):
    turn = "array<struct<role:string,content:string,text:string>>"
    names = ["role", "text", "content", "prompt", "response", "completion", "question", "answer", "instruction", "input", "output", "system"]
    schema = "k int, " + ", ".join(f"{n} string" for n in names) + f", messages {turn}, conversations array<struct<`from`:string,value:string>>"
    rows = {
        "turn_row": {"role": "user", "text": "t"}, "turn_row_content": {"role": "user", "content": "t"}, "prompt_response": {"prompt": "p", "response": "r"}, "prompt_completion": {"prompt": "p", "completion": "c"},
        "question_answer": {"question": "q", "answer": "a"}, "instruction_output": {"instruction": "i", "output": "o"}, "instruction_input_output": {"instruction": "i", "input": "n", "output": "o"},
        "system_instruction_output": {"instruction": "i", "output": "o", "system": "s"}, "messages": {"messages": [("user", "u", None), ("assistant", "a", None)]},
        "messages_text": {"messages": [("user", None, "u"), ("assistant", None, "a")]}, "conversations": {"conversations": [("human", "u"), ("gpt", "a")]},
    }
    assert set(rows) == set(chat.MAPPINGS)
    fields = ["k", *names, "messages", "conversations"]
    partial = {"prompt": "no answer"}
    data = [tuple({**dict.fromkeys(fields), "k": i, **r}[f] for f in fields) for i, r in enumerate([*rows.values(), partial, {"text": None}])]
    got = {r.k: r for r in chat.canonical(spark.createDataFrame(data, schema), fields[1:], "k").collect()}
    assert [got[i].layout for i in range(11)] == list(rows)
    assert all(len(got[i].turns) == (3 if name.startswith("system") else 1 if name.startswith("turn") else 2) for i, name in enumerate(rows))
    # a null answer is an empty one; a row without any field is of no known layout, and stays
    assert (got[11].layout, [tuple(t) for t in got[11].turns]) == ("prompt_response", [("user", "no answer"), ("assistant", "")])
    assert (got[12].layout, got[12].turns) == (None, None)


def test_conversations_in_many_layouts(spark):
    rows = spark.createDataFrame([(c, t, None if (c + t) % 5 == 0 else ["user", "assistant"][t % 2], None if (c + t) % 7 == 0 else f"x{c} {t}") for c in range(-3, 12) for t in range(3)], "conv_id bigint, turn int, role string, text string")
    assert rows_of(chat.layout_digests(chat.in_many_layouts(rows))) == rows_of(chat.conversation_digests(rows))
