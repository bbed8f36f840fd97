"""Text of web pages, as an extractor plug-in."""

from __future__ import annotations

from html.parser import HTMLParser

HTML_MIME = "text/html"
# Elements whose content is not text of the page.
UNSEEN = frozenset({"script", "style", "template", "noscript"})
# Elements inside a line; all others end one.
INLINE = frozenset(
    "a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time "
    "tt u var wbr".split()
)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.unseen: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNSEEN:
            self.unseen.append(tag)
        elif tag not in INLINE:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.unseen and tag == self.unseen[-1]:
            self.unseen.pop()
        elif tag not in INLINE:
            self.parts.append("\n")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)


def html_text(data: bytes) -> str:
    """The visible text, a line per block element, entities decoded, white space collapsed.

    Bytes that are no UTF-8 are replaced; a file with NUL bytes is no page and an error.
    """
    if b"\0" in data:
        raise ValueError("not a text file")
    parser = _Text()
    parser.feed(data.decode("utf-8", "replace"))
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)
