"""Which elements of a page carry which field."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PageProfile:
    """Selectors of one kind of page. An invalid selector selects nothing."""

    title: str
    forum: str
    post_table: str
    post_time: str
    post_content: str
    # Root against which relative links in post bodies are resolved.
    site_root: str = "https://forum.example.org/"


# The forum markup that pages are expected to use.
FORUM = PageProfile(
    title="h1#subject_tpc",
    forum="#breadcrumbs .crumbs-item.gray3:nth-child(3)",
    post_table="table.js-post",
    post_time=".tiptop .gray",
    post_content="div[id^='read_']",
)

# Plain article pages: one article, no author block.
ARTICLE = PageProfile(
    title="h1",
    forum="nav",
    post_table="article",
    post_time="time",
    post_content="article",
    site_root="https://www.example.com/",
)
