"""The inline content of one paragraph under construction: white space, line breaks, runs and links."""

from __future__ import annotations

import re

from vellumite.kernels.styles import Style

Link = tuple[str | None, str | None]  # url, anchor


def cased(text: str, transform: str) -> str:
    """lowercase, or capitalize: the first lower-case letter of every word; upper case is a run property."""
    if transform == "lowercase":
        return text.lower()
    if transform != "capitalize":
        return text
    out, start = [], True
    for c in text:
        out.append(c.upper() if start and c.islower() else c)
        start = c.isspace() or c in "([{\"'-«‘‛“‟‹"
    return "".join(out)


class Flow:
    """Items in order; a text item knows whether its spaces collapse."""

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.fresh = True  # at the start of a line
        self.broken = False  # some line break was met

    def _last(self) -> dict | None:
        """The last item that is not a comment's mark."""
        return next((x for x in reversed(self.items) if not x["kind"].startswith("comment")), None)

    def put(self, kind: str, run: dict | None = None, link: Link | None = None, **more) -> None:
        self.items.append({"kind": kind, "run": run, "link": link, **more})
        self.fresh = False

    def mark(self, kind: str, ref: int) -> None:
        self.items.append({"kind": kind, "ref": ref})

    def line_break(self, run: dict, link: Link | None) -> None:
        self._trim()
        self.put("break", run, link, text="line")
        self.fresh = self.broken = True

    def _text(self, text: str, run: dict, link: Link | None, soft: bool) -> None:
        last = self.items[-1] if self.items else None
        if last and last["kind"] == "text" and last["soft"] == soft and last["run"] == run and last["link"] == link:
            last["text"] += text
            self.fresh = False
        else:
            self.put("text", run, link, text=text, soft=soft)

    def text(self, text: str, run: dict, style: Style, link: Link | None) -> None:
        text = cased(text.replace("\r\n", "\n").replace("\r", "\n"), style.transform)
        lines = text.split("\n") if style.keeps_space or style.space == "pre-line" else [text]
        for k, line in enumerate(lines):
            if k:
                self.line_break(run, link)
            if style.keeps_space:
                for j, piece in enumerate(line.split("\t")):
                    if j:
                        self.put("tab", run, link)
                    if piece:
                        self._text(piece, run, link, False)
                continue
            line = re.sub(r"[ \t\n\f]+", " ", line)
            last = self._last()
            if line[:1] == " " and (self.fresh or (last and last["kind"] == "text" and last["soft"] and last["text"].endswith(" "))):
                line = line[1:]
            if line:
                self._text(line, run, link, True)

    def _trim(self) -> None:
        """Takes collapsible space off the end, before a break or the paragraph's end."""
        for i in range(len(self.items) - 1, -1, -1):
            x = self.items[i]
            if x["kind"].startswith("comment"):
                continue
            if x["kind"] != "text" or not x["soft"]:
                return
            x["text"] = x["text"].rstrip(" ")
            if x["text"]:
                return
            del self.items[i]

    def finish(self) -> list[dict] | None:
        """The paragraph's inlines; None where there was nothing, not even a line break. One break at the end goes."""
        self._trim()
        last = self._last()
        if last and last["kind"] == "break":
            self.items = [x for x in self.items if x is not last]
            self._trim()
        if self._last() is None and not self.broken:
            return None
        return [{k: v for k, v in x.items() if k != "soft"} for x in self.items]
