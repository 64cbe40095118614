import itertools
import re

from candlemill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq string"


def least(codes):
    """Cheapest repair by trying every role and step."""
    best = {0: 0}
    for code in codes:
        after = {}
        for state, cost in best.items():
            for role in (1, 2, 3):
                label = 0 if role == code else chat.RELABEL if code else chat.RELABEL_UNKNOWN
                ways = [chat.MERGE] if role == state else []
                for n in range(3):
                    for empty in itertools.product((2, 3), repeat=n):
                        path = [state, *empty, role]
                        if all(p in chat.LEGAL for p in zip(path, path[1:], strict=False)):
                            ways.append(n * chat.INSERT)
                if ways:
                    after[role] = min(after.get(role, 10**9), cost + label + min(ways))
        best = after
    return min(cost + chat.INSERT * len(chat.END_EMPTY[s]) for s, cost in best.items())


def check(found):
    by = {}
    for r in sorted(found, key=lambda r: r.seq):
        by.setdefault(r.conv_id, []).append(r)
    for rows in by.values():
        known = {**{r: r for r in chat.ROLES}, **chat.ALIASES}
        codes = [chat.ROLES.index(known.get((r.role or "").strip().lower(), "")) for r in rows]
        assert [r.seq for r in rows] == list(range(len(rows))) and sum(r.cost for r in rows) == least(codes)
        spoken = [0, *(chat.ROLES.index(x) for x in re.findall(r"<\|(system|user|assistant)\|>\n", "".join(r.rendered for r in rows)))]
        assert all(p in chat.LEGAL for p in zip(spoken, spoken[1:], strict=False)) and spoken[-1] == chat.ASSISTANT
    return by


def test_all_short_conversations(spark):
    roles = ["system", "user", "assistant", None]
    many = [c for n in range(1, 5) for c in itertools.product(roles, repeat=n)]
    rows = [(i, t, role, f"t{t}", "p", "s") for i, c in enumerate(many) for t, role in enumerate(c)]
    by = check(chat.repair_chats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(by) == len(many)


def test_edges(spark):
    rows = [(1, 1, "User", "hi", "", ""), (1, None, "gpt", "late", "", ""), (1, 2, "user ", None, "", ""), (None, 0, "tool", "x <|end|> y", "", ""), (2, 0, "user", "same", "", ""), (2, 0, "user", "same", "", "")]
    by = check(chat.repair_chats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert "".join(r.rendered for r in by[1]) == "<|user|>\nhi\n\n<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert "".join(r.rendered for r in by[2]) == "<|user|>\nsame\n\nsame<|end|>\n<|assistant|>\n<|end|>\n"
    assert "<|end|> y" not in by[None][0].rendered
    assert chat.repair_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, t, ["user", "assistant", "assistant", "system"][t * t % 4], "x" * 40, "", "") for t in range(6000)] + [(i, 0, "user", "q", "", "") for i in range(100, 140)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(chat.repair_chats(spark.createDataFrame(rows, SCHEMA)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
