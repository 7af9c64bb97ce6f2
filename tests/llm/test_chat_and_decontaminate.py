import hashlib
import re

from plumbline.llm import chat_format, decontaminate

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", r"<\|end|> <\\|end|> \<|end|>", "<<SYS>> a </s>", "", None, "%0A 100% \\n"]


def test_turns_come_back(spark):
    rows = [(c, t, role, NASTY[(c + t) % len(NASTY)]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "us%0A\ner<|end|>", "assistant", "user"][: c + 1])]
    rows += [(None, 0, None, "a"), (None, None, "assistant", "b"), (9, 1, "assistant", "dup"), (9, 1, "assistant", "dup")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, parts string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.prefix_target_examples(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_examples(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more")], "conv_id long, turn long, role string, text string")
    got = sorted(chat_format.prefix_target_examples(frame).collect(), key=lambda r: r["n_turns"])
    assert [r["formatted"] for r in got] == ["<|turn|>user\nhi<|end|>\n<|turn|>assistant\nyo<|end|>\n", "<|turn|>user\nhi<|end|>\n<|turn|>assistant\nyo<|end|>\n<|turn|>user\nmore<|end|>\n"]
    assert got[0]["formatted"][got[0]["loss_start"] : got[0]["loss_end"]] == "yo" and got[1]["loss_start"] == got[1]["loss_end"] and got[1]["target"] is None
    assert chat_format.digest(chat_format.prefix_target_examples(frame.limit(0))).count() == 0


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_equals_brute_force(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = [(1, item.upper()), (1, item.upper()), (2, "x " + " ".join(item.split()[2:12]) + " y"), (3, "a b a b a b a"), (4, None), (5, ""), (6, "É b a b. A! é"), (None, "b a b"), (7, " ".join(item.split()[:9]))]
    items = [(10, item), (2, "b a b"), (3, "B, a: b"), (4, None), (5, "é B"), (6, "")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, w int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1, 10**6):
        got = decontaminate.digest(decontaminate.contamination(frame, bench, block=block)).collect()
        want = []
        for doc, text in docs:
            w, hit, found = word_list(text), set(), set()
            for i, t in items:
                b = word_list(t)
                for s in range(max(1, len(b) - 9)):
                    win = b[s : s + 10]
                    for p in range(len(w) - len(win) + 1):
                        if win and w[p : p + len(win)] == win:
                            hit |= set(range(p, p + len(win)))
                            found.add(str(i))
            want.append((doc or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
        assert sorted((r["doc_id"] or 0, *r[1:]) for r in got) == sorted(want)
    assert [r["contaminated"] for r in decontaminate.contamination(frame, bench.limit(0)).collect()] == [False] * len(docs)
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
