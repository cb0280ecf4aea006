"""Chat formatting: round trips, other templates, templates that rewrite history, streaming, digests by brute force."""

import hashlib

import numpy as np
import pytest

from triagelake.llm import chat_format as C

SHAPE = "conv_id long, turn long, role string, text string, formatted string"
BITS = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/ROLE]", "\\", "<", "[", "/", "s>", "INST]", "é", " ", "\n", "ok", ""]


def conversations(seed, n=25):
    r = np.random.default_rng(seed)
    out = []
    for c in range(n):
        for t in range(int(r.integers(1, 7))):
            role = ["system", "user", "assistant", "tool", "", None, "[ROLE]"][int(r.integers(0, 7))]
            out.append((c, t, role, None if r.random() < 0.05 else "".join(r.choice(BITS) for _ in range(r.integers(0, 12))), "x"))
    return out


def turns_of(rows):
    out = {}
    for c, _, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_marked_texts_come_back(seed):
    for turns in turns_of(conversations(seed, 200)).values():
        formatted, spans, rewritten = C.format_conversation(C.MARKED, turns)
        assert formatted == C.render_marked(turns) and rewritten == []
        assert C.read_marked(formatted) == turns
        for (role, text), (r, a, b, x, y) in zip(turns, spans):
            assert role == r and C.unescape(formatted[x:y]) == text and a <= x <= y <= b
            assert not any(c in formatted[x:y] for c in C.CONTROL)
        assert [s[1] for s in spans[1:]] == [s[2] for s in spans[:-1]] and spans[0][1] == 3 and spans[-1][2] == len(formatted)


def chatml(turns):
    return "".join(f"<|{r}|>\n{t.strip()}<|end|>\n" for r, t in turns)


def folded(turns):
    """The system turn goes into the first user turn, as it was not there before."""
    system = "".join(f"<<{t}>>" for r, t in turns if r == "system")
    users = 0
    out = ""
    for r, t in turns:
        if r == "user":
            out += f"[Q]{system if not users else ''}{t}[/Q]"
            users += 1
        elif r == "assistant":
            out += f"{t}[end]"
    return out


def forgetful(turns):
    """Thoughts of all answers but the last are dropped."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"{r}: {t if k == last else t.split('|')[-1]}\n" for k, (r, t) in enumerate(turns))


def test_other_templates_as_black_boxes():
    turns = [("user", " hi "), ("assistant", "<|end|> x"), ("user", ""), ("assistant", "<")]
    formatted, spans, rewritten = C.format_conversation(C.Template(chatml), turns)
    assert rewritten == [] and [formatted[a:b] for *_, a, b in spans] == ["hi", "<|end|> x", "", "<"]
    turns = [("system", "be kind"), ("user", "q"), ("assistant", "a"), ("user", "r")]
    formatted, spans, rewritten = C.format_conversation(C.Template(folded), turns)
    # the system turn adds nothing when it comes, so its text is not in its span
    assert formatted == "[Q]<<be kind>>q[/Q]a[end][Q]r[/Q]" and rewritten == [] and spans[0][1:] == (0, 0, None, None)
    assert [formatted[a:b] for *_, a, b in spans[1:]] == ["q", "a", "r"]


def test_rewritten_history_is_detected_and_texts_located_in_the_final_output():
    turns = [("user", "q"), ("assistant", "why|one"), ("user", "r"), ("assistant", "so|two")]
    formatted, spans, rewritten = C.format_conversation(C.Template(forgetful), turns)
    assert rewritten == [3] and formatted == "user: q\nassistant: one\nuser: r\nassistant: so|two\n"
    assert [formatted[a:b] for *_, a, b in spans] == ["q", "one", "r", "so|two"]
    late = lambda t: f"{len(t)} turns\n" + "".join(x for _, x in t)
    formatted, spans, rewritten = C.format_conversation(C.Template(late), turns)
    assert rewritten == [0, 1, 2, 3] and [formatted[a:b] for *_, a, b in spans] == [t for _, t in turns]
    odd = lambda t: "".join(sorted(x for _, x in t))
    assert all(s[3] is None or C.format_conversation(C.Template(odd), turns)[0][s[3] : s[4]] in {t for _, t in turns} for s in C.format_conversation(C.Template(odd), turns)[1])
    with pytest.raises(ValueError, match="rewrites"):
        C.format_conversation(C.Template(late, context=0), turns)


def test_long_conversations_start_anew_and_come_out_the_same(monkeypatch):
    numbered = lambda t: "<s>" + "".join(f"[{t[k - 1][0] if k else ''}>{r}]{x}|" for k, (r, x) in enumerate(t))  # noqa: E731  depends on the turn before
    turns = [(["user", "assistant"][k % 2], f"text {k}") for k in range(300)]
    calls = []
    seen = C.Template(lambda t: (calls.append(len(t)), numbered(t))[1], context=1)
    formatted, spans, _ = C.format_conversation(seen, turns)
    assert formatted == numbered(turns) and max(calls) <= C.WINDOW + 3
    assert [formatted[a:b] for *_, a, b in spans] == [t for _, t in turns]


def test_rows_of_a_frame_and_digests(spark):
    rows = conversations(9) + [(None, 0, "user", "no id", "x"), (50, 3, "assistant", "b", "x"), (50, 3, "assistant", "b", "x"), (50, 3, "assistant", "a", "x"), (50, None, "user", "first", "x")]
    frame = spark.createDataFrame(rows, SHAPE)
    want = turns_of(rows)
    got = {r.conv_id: r for r in C.format_chats(frame.repartition(3)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert r.formatted == C.render_marked(turns) and r.rewritten == []
        assert "".join(C.unescape(r.formatted[s.text_start : s.text_end]) for s in r.spans if s.learned) == "".join(t for x, t in turns if x == "assistant")
    own = lambda turns: "".join(t.split("|")[-1 if k < len(turns) - 1 else 0] for k, (_, t) in enumerate(turns))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in C.digests(frame).collect():
        turns = want[r.conv_id]
        loss = "".join(t for x, t in turns if x == "assistant")
        assert tuple(r)[1:] == (len(turns), sha("".join(f"{x}\n{t}\n" for x, t in turns)), len(loss), sha(loss), len(C.render_marked(turns)))
    assert [r.rewritten for r in C.format_chats(spark.createDataFrame([(1, 0, "assistant", "a|b", ""), (1, 1, "assistant", "c", "")], SHAPE), C.Template(own)).collect()] == [[1]]
    empty = spark.createDataFrame([], SHAPE)
    assert C.digests(empty).collect() == [] == C.format_chats(empty).collect()
