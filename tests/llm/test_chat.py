import hashlib
import random

from pyspark.sql import functions as F

from ratewise.llm.chat import (
    escape, format_conversations, instruction_template, parse_instructions, read_back, spans, unescape,
)

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE x]", "[/ROLE]"]


def test_escape_is_reversible_and_leaves_no_control_string():
    r = random.Random(1)
    parts = [*CONTROL, "\\", "\\\\", "<", "[", "/", ">", "]", "s>", "INST]", "<\\s>", "[\\\\INST]", "a", " ", "\n", "ROLE"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        e = escape(t)
        assert unescape(e) == t and not any(c in e for c in CONTROL)


def hashes(rows):
    """Straight from the rows: (n, turns hash, loss chars, loss hash)."""
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    turns = [(r[2] or "", r[3] or "") for r in sorted(rows, key=key)]
    loss = "".join(t for role, t in turns if role == "assistant")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), h("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), h(loss)


def test_against_rows(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 9)):
            text = r.choice([None, "", " ", "probe", "probeprobe", "hi 🙂\n", " [/INST]", "<s>" * 3, "".join(r.choices([*CONTROL, " ", "é"], k=6)), "x" * 5000])
            rows.append((c, r.choice([t, t, 0]), r.choice(["user", "assistant", "system", "tool", "<s>", "a]\nb", "\\]", None, ""]), text))
    rows += [(None, None, None, None), (None, 1, "assistant", "a"), (50, 0, "assistant", "same"), (50, 0, "assistant", "same")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(1)).repartition(5)
    out = read_back(format_conversations(df)).collect()
    want = {c: hashes([x for x in rows if x[0] == c]) for c in {x[0] for x in rows}}
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in out} == want
    for x in out:
        assert x.rewritten_at is None and x.formatted_chars == len(x.formatted)
        assert "".join(x.formatted[s.start:s.end] for s in x.spans) == x.formatted
    assert format_conversations(df.limit(0)).count() == 0


def test_turns_are_read_out_of_the_string_alone():
    a, b = [("a]\nb", "x")], [("a", "b]\nx")]
    assert instruction_template(a) != instruction_template(b)
    r = random.Random(3)
    parts = [*CONTROL, "\\", "]", "[", "\n", " ", "<", "n", "s>", "a", "]\n", "\n[/ROLE]\n", " [/INST]", " </s>"]
    some = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 6)))
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "system", some()]), some()) for _ in range(r.randint(0, 4))]
        assert parse_instructions(instruction_template(turns)) == turns


def test_texts_that_a_template_repeats_or_changes_have_no_span():
    twice = lambda turns: "".join(f"{t}|{t};" for _, t in turns)
    upper = lambda turns: "".join(f"<{t.upper()}>" for _, t in turns)
    turns = [("user", "ab"), ("assistant", "c")]
    assert spans(turns, twice) == ("ab|ab;c|c;", [(0, 6, None, None), (6, 10, None, None)], None)
    assert spans(turns, upper) == ("<AB><C>", [(0, 4, None, None), (4, 7, None, None)], None)


def drops_old_thoughts(turns):
    """A template that shows <think> blocks of the last assistant turn only."""
    out = []
    for k, (role, text) in enumerate(turns):
        if role == "assistant" and k < len(turns) - 1:
            text = text.split("</think>")[-1]
        out.append(f"{role}: {text}\n")
    return "".join(out)


def test_templates_that_rewrite_history_are_detected(spark):
    turns = [("user", "a"), ("assistant", "<think>x</think>b"), ("user", "c"), ("assistant", "d")]
    assert spans(turns, drops_old_thoughts) == (drops_old_thoughts(turns), [], 2)
    assert spans(turns[:2], drops_old_thoughts)[2] is None
    assert spans([("user", "a")], lambda t: f"{len(t)} turns" if t else "none")[2] == 0
    rows = [(1, k, *t) for k, t in enumerate(turns)] + [(2, 0, "user", "a")]
    got = {x.conv_id: x for x in format_conversations(spark.createDataFrame(rows, SCHEMA), drops_old_thoughts).collect()}
    assert got[1].rewritten_at == 2 and got[1].spans == [] and got[2].rewritten_at is None


def test_another_template_with_trimmed_text():
    template = lambda turns: "".join(f"<|{r}|>{t.strip()}<|end|>" for r, t in turns)
    whole, found, rewritten = spans([("user", " hi "), ("assistant", "<|end|>"), ("user", "")], template)
    assert rewritten is None and [whole[a:b] for _, _, a, b in found] == ["hi", "<|end|>", ""]


def test_control_strings_from_the_contract(spark):
    said = "</s>[INST] ok [/INST]"
    whole = instruction_template([("user", said), ("assistant", said)])
    assert whole.count("[INST]") == 1 and whole.count("</s>") == 1 and whole.count("[/INST]") == 1
