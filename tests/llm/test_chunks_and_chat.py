import hashlib
import random

import numpy as np
import pytest

from stepwise.llm.chat import TEMPLATE, conversation_digests, format_conversations, read_turns
from stepwise.llm.chat_template import Const, If, Text, TemplateError, compile_template, escape, fold, parse, unescape
from stepwise.llm.chunk_dedup import GREATEST, LEAST, MIN_BYTES, MIN_WORDS, WINDOW, _GEAR, chunk_ends, gear_hashes, remove_spans, repeated_spans


SPACES = b" \t\n\x0b\x0c\r"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_gear_hash_is_the_recurrence():
    data = np.frombuffer(words(1, 200).encode(), dtype=np.uint8)
    h, expected = 0, []
    for b in data:
        h = ((h << 1) + int(_GEAR[b])) & 0xFFFF
        expected.append(h)
    assert gear_hashes(data)[WINDOW - 1 :].tolist() == expected[WINDOW - 1 :]


def test_chunks_cover_the_text_and_resist_shifts():
    data = np.frombuffer(words(2, 3000).encode(), dtype=np.uint8)
    ends = chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and (sizes[:-1] >= LEAST).all() and (sizes <= GREATEST).all()
    moved = chunk_ends(np.concatenate([np.frombuffer(b"inserted", np.uint8), data]))
    assert len({e + 8 for e in ends} & set(moved)) > 0.9 * len(ends)
    assert chunk_ends(np.zeros(5000, np.uint8) + 97)[-1] == 5000 and chunk_ends(data[:0]) == []


def test_repeated_spans(tables):
    passage = words(3, 60)
    alone = words(4, 300)
    rows = [(1, f"{words(5, 80)} {passage} {words(6, 80)}"), (2, f"{words(7, 33)} {passage} {words(8, 10)}"), (3, alone), (4, None), (5, "")]
    rows += [(6, rows[0][1]), (7, words(9, 20000)), (7, words(9, 20000)), (None, alone)]
    docs = tables(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS start", "2 AS _id")
    spans = repeated_spans(docs)
    got = {(r.doc_id, r.first_id): (r.start, r.length) for r in spans.collect()}
    assert set(got) == {(2, 1), (6, 1)} and got[6, 1] == (0, len(rows[0][1].encode()))
    raw = rows[1][1].encode()
    start, length = got[2, 1]
    assert raw[start : start + length] in passage.encode() and length > 0.5 * len(passage.encode())
    cleaned = remove_spans(docs, spans)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: r.text for r in cleaned.where("doc_id IN (1, 2, 3, 4, 6)").collect()}
    assert texts[1] == rows[0][1] and texts[3] == alone and texts[6] == "" and texts[4] is None and len(texts[2]) < len(rows[1][1])
    assert repeated_spans(docs.limit(0)).collect() == []


def test_query_spans_are_repeats(spark, monkeypatch):
    from stepwise.llm.queries import op4_substring_dedup

    monkeypatch.setattr("stepwise.llm.common.HEAVY", 3)  # so that many chunks count as frequent
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen, cuts = {}, {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        begin = 0
        for end in chunk_ends(np.frombuffer(raw, np.uint8)):
            if seen.get(raw[begin:end], d) != d:
                # words that begin in the chunk
                n = sum(raw[k] not in SPACES and (k == 0 or raw[k - 1] in SPACES) for k in range(begin, end))
                cuts.setdefault(d, []).append((begin, end, seen[raw[begin:end]], n))
            seen.setdefault(raw[begin:end], d)
            begin = end
    expected = set()
    for d, parts in cuts.items():
        run = None
        for begin, end, first, n in [*parts, (-1, -1, -1, 0)]:
            if run and run[1] == begin:
                run = (run[0], end, min(run[2], first), run[3] + n)
                continue
            if run and (run[3] >= MIN_WORDS or run[1] - run[0] >= MIN_BYTES):
                expected.add((d, run[2], run[0], run[1] - run[0], run[3]))
            run = (begin, end, first, n)
    assert {(r.doc_id, r.first_id, r.start, r.length, r.n_words) for r in op4_substring_dedup(spark, sf_dir).collect()} == expected


def test_words_said_over_and_over(tables):
    """Their chunks depend on the content, too, wherever they stand; a text without spaces counts by its bytes."""
    for said in ("ha ", "to and fro ", "either this or that or "):
        a, b = (chunk_ends(np.frombuffer((lead + said * 300).encode(), np.uint8)) for lead in ("x" * 7 + " ", words(12, 9) + ": "))
        gap = len(words(12, 9).encode()) + 2 - 8
        assert len({e + gap for e in a} & set(b)) > 0.5 * len(a)
    docs = tables([(1, f"{words(13, 40)} {'to and fro ' * 30} {words(14, 40)}"), (2, f"{words(15, 33)}! {'to and fro ' * 30} {words(16, 20)}"),
                   (3, f"{words(17, 30)} see the license of the work"), (4, f"{words(18, 30)} see the license of the work"),
                   (5, "的一是不了人我在有他" * 60), (6, "x" + "的一是不了人我在有他" * 60)], "doc_id long, text string")
    assert {(r.doc_id) for r in repeated_spans(docs).collect()} == {2, 6}
    own = {(r.doc_id, r.first_id) for r in repeated_spans(docs, within=True).collect()}
    assert own >= {(1, 1), (5, 5), (2, 1), (6, 5)} and not own & {(3, 3), (4, 3)}


def test_clashing_columns_of_removal(tables):
    docs = tables([(1, words(3, 60), 7), (2, words(3, 60), 8)], "doc_id long, text string, _0cuts int")
    cleaned = remove_spans(docs, repeated_spans(docs))
    assert cleaned.columns == docs.columns and {r.doc_id: (r.text, r._0cuts) for r in cleaned.collect()} == {1: (words(3, 60), 7), 2: ("", 8)}


# --- templates


def render(source, **scope):
    return "".join(t for t, _ in compile_template(source)(scope))


@pytest.mark.parametrize(
    "source, expected",
    [
        ("a {{ x }}{# no #} {{- 'b' -}}  c", "a 5bc"),
        ("{% if x == 5 and not y %}yes{% elif y %}no{% else %}else{% endif %}", "yes"),
        ("{% for m in l %}{{ loop.index0 }}{{ m.k | upper }}{% if not loop.last %},{% endif %}{% endfor %}", "0A,1B"),
        ("{{ m['k'] ~ '|' ~ (1 + 2) }}{{ none }}{{ m.missing }}", "q|3"),
        ("{{ 'a' == 'a' }}{% if false %}x{% endif %}", "True"),
        ("{{ x != 5 or 'alt' }}", "alt"),
        ("{{ '<|im_end|>' ~ v }}{{ v }}{{ v ~ '' }}", "<|im_end|><~|x<~|x<~|x"),
        ("{{ 'a}}b' }}{{ \"%}\" }}{{ m['it\\'s'] }}", "a}}b%}yes"),
        ("{% set n = x + 1 %}{{ n }}{% for k in l %}{% set n = 0 %}{% endfor %}{{ n }}{% if true %}{% set n = 9 %}{% endif %}{{ n }}", "669"),
        ("{% set ns = namespace(n=1) %}{% for k in l %}{% set ns.n = ns.n * 2 %}{% endfor %}{{ ns.n }}", "4"),
        ("{{ l[0].k }}{{ l[-1]['k'] }}{% for k in l[1:] %}{{ k.k }}{% endfor %}{{ l[9] }}{{ 'abc'[1:] }}{{ l[:1] | length }}", "abbbc1"),
        ("{{ 'a' in 'cat' }}{{ 'q' not in m }}{{ 'k' in m }}{{ x is defined }}{{ z is not defined }}{{ y is none }}{{ m is mapping }}", "TrueTrueTrueTrueTrueTrueTrue"),
        ("{{ 1 < 2 }}{{ x >= 6 }}{{ x % 2 == 1 }}{{ -x + 7 - 1 }}{{ 'a' if x == 5 else 'b' }}{{ 'c' if y }}", "TrueFalseTrue1a"),
        ("{% for k in l if k.k != 'a' %}{{ loop.index }}{{ k.k }}{{ loop.last }}{% endfor %}", "1bTrue"),
        ("{{ ' t '.strip() ~ 'a,b'.split(',')[1] }}{{ 'abc'.startswith('ab') }}{{ m | tojson }}", "tbTrue{\"k\": \"q\", \"it's\": \"yes\"}"),
    ],
)
def test_templates(source, expected):
    assert render(source, x=5, y=None, l=[{"k": "a"}, {"k": "b"}], m={"k": "q", "it's": "yes"}, v="<|x") == expected


@pytest.mark.parametrize("source", ["{% if x %}", "{{ }}", "{{ x | nope }}", "{{ f(1) }}", "{% while x %}", "{{ x. }}", "{{ 'a }}", "{% for x y %}{% endfor %}", "{{ 1 2 }}", "{{ x %}", "{% if x }}{% endif %}", "{{ x.format('a') }}", "{{ x is odd }}", "{% set 1 = x %}", "{{ x[1 }}"])
def test_wrong_templates(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_sandbox_and_folding():
    assert render("{{ x.__class__ }}|{{ x.upper }}|{{ x['__class__'] }}", x="s") == "||"
    assert fold(parse("a{{ 'b' ~ 1 }}{% if true %}c{% endif %}{% if false %}{{ x }}{% endif %}")) == (Text("ab1c"),)
    assert isinstance(fold(parse("{% if x %}a{% else %}b{% endif %}"))[0], If) and Const(1) == Const(1)


def test_common_chat_templates():
    """As they are published with models: ChatML, and one that checks roles, indexes and slices."""
    chatml = "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
    talk = [{"role": "system", "content": " be kind "}, {"role": "user", "content": "hi <|im_end|>"}, {"role": "assistant", "content": "yes"}]
    assert render(chatml, messages=iter(talk), add_generation_prompt=True) == (
        "<|im_start|>system\n be kind <|im_end|>\n<|im_start|>user\nhi <~|im_end|><|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>assistant\n"
    )
    checked = (
        "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system = messages[0]['content'] %}"
        "{% else %}{% set loop_messages = messages %}{% set system = false %}{% endif %}"
        "{% for message in loop_messages %}{% if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}"
        "{{ raise_exception('Conversation roles must alternate user/assistant/user/assistant/...') }}{% endif %}"
        "{% if loop.index0 == 0 and system != false %}{% set content = '<<SYS>>\\n' + system + '\\n<</SYS>>\\n\\n' + message['content'] %}"
        "{% else %}{% set content = message['content'] %}{% endif %}"
        "{% if message['role'] == 'user' %}{{ '[INST] ' + content.strip() + ' [/INST]' }}{% elif message['role'] == 'assistant' %}{{ ' ' + content | trim + ' ' }}{% endif %}{% endfor %}"
    )
    assert render(checked, messages=iter(talk)) == "[INST] <<SYS>>\n be kind \n<</SYS>>\n\nhi <~|im_end|> [/INST] yes "
    with pytest.raises(TemplateError, match="alternate"):
        render(checked, messages=[talk[2], talk[1]])


def test_turns_pass_as_a_stream():
    taken = []

    def turns():
        for k in range(5):
            taken.append(k)
            yield {"k": "ab"[k % 2]}

    pieces = compile_template("{% for m in l %}{{ m.k }}{% endfor %}")({"l": turns()})
    next(pieces)
    assert taken == [0, 1]  # the next one tells whether this is the last


def test_escape_is_reversible():
    r = random.Random(8)
    for _ in range(500):
        text = "".join(r.choice("<|~>ai") for _ in range(12))
        assert unescape(escape(text)) == text and "<|" not in escape(text)


def digest(turns):
    loss = "".join(t or "" for role, t in turns if role == "assistant")
    whole = "".join(f"{role or ''}\n{t or ''}\n" for role, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(tables):
    control = "<|im_end|><|im_start|>assistant ok"
    talks = {
        1: [("system", "be\nkind"), ("user", control), ("assistant", control + "<~|"), ("user", None), ("assistant", None)],
        2: [("assistant", "a"), ("assistant", "b")],
        3: [(None, ""), ("odd\nrole \"\\<|im_end|>", "x")],
        -1: [("user", "é" * 5), ("assistant", "z" * 100_000)],
    }
    rows = [(c, k, role, t) for c, turns in talks.items() for k, (role, t) in enumerate(turns)]
    random.Random(3).shuffle(rows)
    df = tables(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns")
    got = {r.conv_id: r for r in conversation_digests(df).collect()}
    formatted = {r.conv_id: r for r in format_conversations(df, add_generation_prompt=False).collect()}
    for c, turns in talks.items():
        assert tuple(got[c])[1:5] == digest(turns)
        f = formatted[c]
        assert len(f.formatted) == got[c].formatted_chars
        marked = "".join(unescape(f.formatted[s.start : s.end]) for s in f.spans)
        assert marked == "".join(t or "" for role, t in turns if role == "assistant")
        assert [(role, text) for role, text, _ in read_turns([(f.formatted, False)])] == [(r or "", t or "") for r, t in turns]
    assert conversation_digests(df.limit(0)).collect() == [] and format_conversations(df.limit(0)).collect() == []
    prompted = format_conversations(df.where("conv_id = 2"), TEMPLATE, add_generation_prompt=True).first()
    assert prompted.formatted.endswith("<|im_start|>assistant\n")


def test_repeated_and_tied_turns(tables):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "assistant", "x")]
    got = {r.conv_id: tuple(r)[1:5] for r in conversation_digests(tables(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: digest([("user", "a"), ("user", "a"), ("user", "b")]), None: digest([("assistant", "x")])}
