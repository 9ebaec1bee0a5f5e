from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from postpulse.llm import quality as q


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=20))
def test_repeated_words_by_definition(words):
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    assert q.repeated_words(words) == len(inside)


def test_statistics_and_edge_cases(spark, docs):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(1, clean), (2, None), (3, ""), (4, clean + " " + "$$ %% " * 30), (5, clean.upper()),
            (6, "é é \x0b# #\n\nx\nx\r\n x"), (None, clean), (1, clean), (7, "!! ".join(clean.split()))]
    out = {}
    for r in q.apply_rules(docs(rows)).collect():
        out.setdefault(r.doc_id, r)
    assert out[1].kept and out[1].n_words == 80 and out[None].kept
    assert out[2].base_failed and out[2].n_words == 0 and out[3].base_failed
    assert out[4].rejected_by == "symbol_heavy" and out[5].rejected_by == "capitals"
    assert out[7].rejected_by == "shouting"
    # the no-break space joins its neighbours; '\\n x' differs from 'x' as a line
    assert (out[6].n_words, out[6].word_chars, out[6].n_symbols, out[6].n_dup_lines) == (6, 8, 2, 0)
    assert q.apply_rules(docs([])).count() == 0


def test_order_changes_nothing_but_the_first_reason(spark, docs):
    rows = [(i, f"AB{i} " * 60 if i % 2 else " ".join(f"w{chr(97 + i % 20)}{k} $" for k in range(60)))
            for i in range(20)]
    names = [r.__name__ for r in q.RULES]
    a = {r.doc_id: r.kept for r in q.apply_rules(docs(rows), order=names).collect()}
    b = {r.doc_id: r.kept for r in q.apply_rules(docs(rows), order=names[::-1]).collect()}
    assert a == b
    assert sorted(q.plan_cascade(docs(rows).select("doc_id", "text"))) == sorted(names)
