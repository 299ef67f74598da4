"""Comment ranges and threads of one document's model."""

from __future__ import annotations

from collections.abc import Iterator


def paragraphs(blocks: list[dict]) -> Iterator[dict]:
    """Paragraphs in reading order, through the cells of tables."""
    for block in blocks:
        if block["kind"] == "paragraph":
            yield block
        else:
            for row in block["rows"]:
                for cell in row["cells"]:
                    yield from paragraphs(cell["blocks"])


def threads(comments: list[dict]) -> list[dict]:
    """Comments whose parent is known and leads to a root keep it and take the root's `resolved`; others are roots."""
    by_id = {c["id"]: c for c in comments}
    out = []
    for c in comments:
        at, seen = c, {c["id"]}
        while at["parent"] in by_id and at["parent"] not in seen:
            at = by_id[at["parent"]]
            seen.add(at["id"])
        known = c["parent"] in by_id and at["parent"] is None
        out.append({**c, "parent": c["parent"] if known else None, "resolved": at["resolved"] if known else c["resolved"]})
    return out


def balance(containers: list[list[dict]], comments: list[dict]) -> list[dict]:
    """Gives every comment one start and one end in the paragraphs, changed in place; returns the comments as threads.

    The first of several marks counts and marks of unknown comments go. An end without a start is a point there, a
    start without an end a point too, a comment without either a point before the first paragraph's content.
    """
    known = {c["id"] for c in comments}
    every = [p for blocks in containers for p in paragraphs(blocks)]
    opened: dict[int, tuple[dict, dict]] = {}
    closed: set[int] = set()
    for p in every:
        kept = []
        for x in p["inlines"]:
            if x["kind"] not in ("comment_start", "comment_end"):
                kept.append(x)
                continue
            one, opens = x["ref"], x["kind"] == "comment_start"
            if one not in known or one in (opened if opens else closed):
                continue
            if opens:
                opened[one] = (p, x)
            else:
                closed.add(one)
                if one not in opened:
                    start = {"kind": "comment_start", "ref": one}
                    opened[one] = (p, start)
                    kept.append(start)
            kept.append(x)
        p["inlines"] = kept
    for one, (p, start) in opened.items():
        if one not in closed:
            at = next(i for i, x in enumerate(p["inlines"]) if x is start)
            p["inlines"].insert(at + 1, {"kind": "comment_end", "ref": one})
    lost = [c for c in comments if c["id"] not in opened]
    if lost and every:
        for c in lost:
            every[0]["inlines"][:0] = [{"kind": "comment_start", "ref": c["id"]}, {"kind": "comment_end", "ref": c["id"]}]
    return threads([c for c in comments if c["id"] in opened or every])
