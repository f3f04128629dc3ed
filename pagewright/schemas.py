"""Record shapes shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pagewright.functions import fixed

FETCHED = "url string, fetched_url string, status int, content_type string, html string"
SKIPPED = "site_id string, url string, reason string"
DISCOVERED = "site_id string, url string, depth int"
ATTEMPTS = "array<struct<strategy:string,text_len:int,success:boolean>>"
PAGE_DOC = (
    "url string, fetched_url string, extracted_at string, title string, subtitle string, "
    "author string, date_published string, language string, text string, "
    f"extraction_attempts {ATTEMPTS}, warnings array<string>"
)

_EXAMPLE = "array<struct<body:string,schema:string>>"
_ACTION = (
    "struct<name:string,method:string,uriTemplate:string,description:string,"
    f"examples:array<struct<requests:{_EXAMPLE},responses:{_EXAMPLE}>>>"
)
_RESOURCE = f"struct<name:string,uriTemplate:string,description:string,actions:array<{_ACTION}>>"
API_PAYLOAD = (
    "struct<name:string,subdomain:string,urls:map<string,string>,description:string,"
    f"resourceGroups:array<struct<name:string,description:string,resources:array<{_RESOURCE}>>>>"
)
SITEMAP_XML = (
    "struct<url:array<struct<loc:string>>,sitemap:array<struct<loc:string>>,broken:string>"
)


@dataclass(frozen=True)
class CrawlParams:
    """Options of a site run, the same for every site of the run. Without ``max_pages`` nothing is cut."""

    max_pages: int | None = fixed.DEFAULT_MAX_PAGES
    delay: float = 1.0
    jitter: float = 0.3
    concurrency: int = 2
    respect_robots: bool = True
    include_external: bool = False
    query_filter: bool = True
    allow_patterns: tuple[str, ...] = field(default=())
    deny_patterns: tuple[str, ...] = field(default=())
    override_hard_cap: bool = False

    def __post_init__(self) -> None:
        if self.max_pages is not None and self.max_pages <= 0:
            raise ValueError("max_pages must be positive")
        if self.concurrency <= 0:
            raise ValueError("concurrency must be positive")
        if (self.max_pages is None or self.max_pages > fixed.HARD_MAX_PAGES) and not self.override_hard_cap:
            raise ValueError(f"max_pages above {fixed.HARD_MAX_PAGES} needs override_hard_cap")
