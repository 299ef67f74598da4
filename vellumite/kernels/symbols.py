"""Unicode of the places of symbol fonts."""

from __future__ import annotations

# Signs from a place on, in the fonts' order; (first sign, how many) where Unicode has them in a row.
SYMBOL = {
    0x20: " !∀#∃%&∍()*+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}~",
    0xA0: "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭",
}
WINGDINGS = {
    0x20: " 🖉✂✁👓🕭🕮🕯🕿✆🖂🖃📪📫📬📭", 0x30: "🗀🗁🗎🗏🗐🗄⌛🖮🖰🖲🖳🖴🖫🖬✇✍", 0x40: "🖎✌🖏👍👎☜☞☝☟🖐☺😐☹💣🕱🏳",
    0x50: "🏱✈☼🌢❄🕆✞🕈✠✡☪☯🕉☸", 0x5E: ("♈", 12), 0x6A: "🙰🙵⚫🔾◼🞏🞐❑❒🞟⧫◆❖⬩⌧⮹⌘🏵🏶🙶🙷▯",
    0x80: "\U0001f10b", 0x81: ("➀", 10), 0x8B: "\U0001f10c", 0x8C: ("➊", 10),
    0x96: "🙢🙠🙡🙣🙞🙜🙝🙟∙•⬝⭘🞆🞈🞊🞋🔿▪🞎🟁🟅★🟋🟏🟓🟑⯐⌖⯎⯏⯑✪✰", 0xB7: ("🕐", 12), 0xC3: ("⮰", 8),
    0xCB: "🙪🙫🙕🙔🙗🙖🙐🙑🙒🙓⌫⌦⮘⮚⮙⮛⮈⮊⮉⮋🡨🡪🡩🡫🡬🡭🡯🡮🡸🡺🡹🡻🡼🡽🡿🡾⇦⇨⇧⇩⬄⇳⬁⬀⬃⬂🢬🢭🗶✓🗷🗹",
}


def _places(signs: dict) -> dict[int, str]:
    out = {}
    for first, run in signs.items():
        run = run if isinstance(run, str) else [chr(ord(run[0]) + i) for i in range(run[1])]
        out |= {first + i: sign for i, sign in enumerate(run)}
    return out


FONTS = {"symbol": _places(SYMBOL), "wingdings": _places(WINGDINGS)}


def symbol(font: str | None, code: int) -> str | None:
    """Unicode of a symbol font's place; the private-use offset does not matter."""
    return FONTS.get((font or "").strip().lower(), {}).get(code - 0xF000 if code >= 0xF000 else code)
