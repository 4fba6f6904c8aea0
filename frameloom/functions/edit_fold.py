"""Edits of a log on the pages of one source, as plain Python for tasks."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable


class PageIndex:
    """The pages of one source in time order, with an index by identifier and one by sample.

    An edit costs a search and a shift in the ordered keys, not a new list: pages of equal time keep the order in which they came
    (``place``). ``touched`` collects the identifiers of pages that edits added, changed or removed.
    """

    def __init__(self, pages: Iterable[dict] = ()) -> None:
        self._pages: dict[str, dict] = {}
        self._by_sample: dict[int, list[str]] = {}
        self.touched: set[str] = set()
        for n, page in enumerate(pages):
            self._pages[page["page_id"]] = {"place": n} | page
        self._order = sorted((p["ticks"], p["place"], i) for i, p in self._pages.items())
        self._next = 1 + max((p["place"] for p in self._pages.values()), default=-1)
        for _, _, page_id in self._order:
            self._by_sample.setdefault(self._pages[page_id]["rep_ordinal"], []).append(page_id)

    def __len__(self) -> int:
        return len(self._order)

    def page(self, page_id: str) -> dict | None:
        return self._pages.get(page_id)

    def rows(self) -> list[dict]:
        """The pages in time order, without their places."""
        return [{k: v for k, v in self._pages[i].items() if k != "place"} for _, _, i in self._order]

    def load(self, page: dict) -> None:
        """A page that is there from the start."""
        self._put(page)

    def _put(self, page: dict) -> None:
        page = page | {"place": self._next}
        self._next += 1
        self._pages[page["page_id"]] = page
        self._by_sample.setdefault(page["rep_ordinal"], []).append(page["page_id"])
        insort(self._order, (page["ticks"], page["place"], page["page_id"]))
        self.touched.add(page["page_id"])

    def _at(self, page: dict) -> int:
        return bisect_left(self._order, (page["ticks"], page["place"], page["page_id"]))

    def _take(self, page_id: str) -> dict:
        page = self._pages.pop(page_id)
        del self._order[self._at(page)]
        self._by_sample[page["rep_ordinal"]].remove(page_id)
        self.touched.add(page_id)
        return page

    def apply(self, edit: dict) -> tuple[str, str | None, str | None]:
        """One edit (kind, page_ids, to_ordinal, to_ticks, to_segment_ix, new_id): its status, code and focus."""
        ids = list(dict.fromkeys(edit["page_ids"] or []))
        kind = edit["kind"]
        if kind in ("add", "replace"):
            return self._place(kind, ids, edit)
        if any(i not in self._pages for i in ids):
            return "rejected", "UnknownPage", None
        if kind == "merge":
            if len(ids) < 2:
                return "no_op", "NeedMultiplePages", ids[0] if ids else None
            last = max(ids, key=lambda i: self._pages[i]["ticks"])
            for i in ids:
                if i != last:
                    self._take(i)
            return "changed", None, last
        if not ids:
            return "no_op", "EmptySelection", None
        first = min(self._at(self._pages[i]) for i in ids)
        for i in ids:
            self._take(i)
        return "changed", None, self._order[min(first, len(self._order) - 1)][2] if self._order else None

    def _place(self, kind: str, ids: list[str], edit: dict) -> tuple[str, str | None, str | None]:
        holder = next(iter(self._by_sample.get(edit["to_ordinal"], ())), None)  # of pages with one sample the first
        moved = {"rep_ordinal": edit["to_ordinal"], "ticks": edit["to_ticks"], "derived_segment_ix": edit["to_segment_ix"], "last_edit": kind}
        if kind == "add":
            if holder is not None:
                return "no_op", "AlreadySelected", holder
            self._put({"page_id": edit["new_id"], "origin": "manual", "origin_segment_ix": None} | moved)
            return "changed", None, edit["new_id"]
        own = ids[0] if ids else None
        if own not in self._pages:
            return "rejected", "UnknownPage", None
        if holder == own:
            return "no_op", "SameSample", own
        if holder is not None:
            return "rejected", "DuplicateSample", own
        self._put(self._take(own) | moved)
        return "changed", None, own


def apply_edit(rows: list[dict], edit: dict) -> tuple[list[dict], str, str | None, str | None]:
    """One edit on a list of pages in time order: the new pages, status, code and focus."""
    index = PageIndex(rows)
    told = index.apply(edit)
    return index.rows(), *told
