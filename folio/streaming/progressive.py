"""A file that is read in parts: which byte ranges a page needs, and a file of that page alone."""

from __future__ import annotations

import re

from folio.core import writer
from folio.core.objects import Document, Name, PdfError, Ref, references, remap

from .files import add_range

#: Bytes asked for where an object's end isn't known, and of the end of a file.
MOST, TAIL = 65536, 1024

Range = tuple[int, int]


class Progressive:
    """Bytes fed so far of a file of known length.

    ``needed(i)`` gives the ranges to feed next for page i, empty if the page is
    there: first the cross-reference, then the page tree, then what the page
    refers to. Feeding may need several rounds, as what is read names more.
    """

    def __init__(self, length: int):
        self.length, self.data, self.have = length, bytearray(length), []
        self._doc: Document | None = None

    def feed(self, offset: int, data: bytes) -> None:
        end = min(offset + len(data), self.length)
        if end > offset:
            self.data[offset:end] = data[: end - offset]
            self.have = add_range(self.have, offset, end)
            self._doc = None

    def has(self, first: int, end: int) -> bool:
        return any(a <= first and min(end, self.length) <= b for a, b in self.have)

    def document(self) -> tuple[Document | None, list[Range]]:
        """The file with its cross-reference, or the ranges that lack for it."""
        if self._doc is not None:
            return self._doc, []
        tail = max(0, self.length - TAIL)
        if not self.has(tail, self.length):
            return None, [(tail, self.length)]
        found = re.findall(rb"startxref\s+(\d+)", bytes(self.data[tail:]))
        if not found:
            raise PdfError("InvalidXref", "no startxref in the tail")
        seen, at = set(), int(found[-1])
        while at is not None and at not in seen:  # every section back to the first
            seen.add(at)
            if not self.has(at, min(at + MOST, self.length)):
                return None, [(at, min(at + MOST, self.length))]
            before = re.search(rb"/Prev\s+(\d+)", bytes(self.data[at : at + MOST]).partition(b"startxref")[0])
            at = int(before[1]) if before else None
        self._doc = Document(bytes(self.data))
        return self._doc, []

    def _range(self, doc: Document, num: int) -> Range | None:
        """Where an object, or the stream that holds it, stands; at most up to the next one."""
        entry = doc.xref.get(num)
        if entry is None:
            return None
        if entry[2] == "compressed":
            return self._range(doc, entry[0])
        ends = sorted(e[0] for e in doc.xref.values() if e is not None and e[2] != "compressed" and e[0] > entry[0])
        return entry[0], min(ends[0] if ends else self.length, self.length)

    def _walk(self, doc: Document, page: int) -> tuple[int | None, list[Range]]:
        """The page's object, or what lacks on the way to it."""
        todo, left, seen = [doc.trailer.get("Root")], page, set()
        while todo:
            ref = todo.pop(0)
            if not isinstance(ref, Ref) or ref.num in seen:
                continue
            seen.add(ref.num)
            where = self._range(doc, ref.num)
            if where and not self.has(*where):
                return None, [where]
            d = doc.resolve(ref)
            if not isinstance(d, dict):
                continue
            if d.get("Type") == "Catalog" or "Pages" in d:
                todo = [d.get("Pages")]
            elif "Kids" in d:
                count = doc.resolve(d.get("Count"))
                if isinstance(count, int) and left >= count:
                    left -= count
                    continue
                kids = doc.resolve(d["Kids"]) or []
                if count == len(kids) and left < count:  # all of them are pages
                    kids, left = [kids[left]], 0
                todo = [*kids, *todo]
            elif left == 0:
                return ref.num, []
            else:
                left -= 1
        raise PdfError("PageOutOfRange", f"no page {page}")

    def _objects(self, doc: Document, num: int) -> tuple[set[int], list[Range]]:
        """What a page refers to, but for the tree above it and other pages, and what of it lacks."""
        seen, lacking, todo = set(), [], [num]
        while todo:
            n = todo.pop()
            where = self._range(doc, n)
            if n in seen or where is None:
                continue
            seen.add(n)
            if not self.has(*where):
                lacking = add_range(lacking, *where)
                continue
            x = doc.get(n)
            if isinstance(x, dict) and n != num and x.get("Type") in ("Page", "Pages"):
                seen.discard(n)
                continue
            own = {k: v for k, v in x.items() if k != "Parent"} if n == num else x
            todo += [m for _, m in references(own)]
        return seen, lacking

    def needed(self, page: int) -> list[Range]:
        doc, lacking = self.document()
        if doc is None:
            return lacking
        num, lacking = self._walk(doc, page)
        return lacking if num is None else self._objects(doc, num)[1]

    def ready(self, page: int) -> bool:
        return not self.needed(page)

    def page_document(self, page: int) -> bytes:
        """A file of one page that is ready, with the attributes it has from above."""
        if self.needed(page):
            raise PdfError("NotReady", f"page {page} isn't all there")
        doc, _ = self.document()
        num, _ = self._walk(doc, page)
        keep = sorted(self._objects(doc, num)[0])
        to = {n: i + 3 for i, n in enumerate(keep)}
        own, above, seen = dict(doc.get(num)), doc.get(num).get("Parent"), set()
        while isinstance(above, Ref) and above.num not in seen:
            seen.add(above.num)
            d = doc.resolve(above)
            own = {k: d[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in d} | own
            above = d.get("Parent")
        objects = {to[n]: remap(doc.get(n), lambda m: to.get(m, 0)) for n in keep if n != num}
        inherited = {k: v for k, v in own.items() if k != "Parent"}
        objects[to[num]] = remap(inherited, lambda m: to.get(m, 0)) | {"Parent": Ref(2, 0)}
        objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
        objects[2] = {"Type": Name("Pages"), "Kids": [Ref(to[num], 0)], "Count": 1}
        return writer.write(objects, {"Root": Ref(1, 0)})
