"""Fixed values. Results depend on these exact entries, so they are stated as plain text."""

# File extensions whose URLs are downloads, not pages.
BINARY_EXTENSIONS = (
    ".7z .avi .bin .bz2 .csv .doc .docx .epub .exe .gif .gz .ico .jpeg .jpg .json .mov .mp3 .mp4 "
    ".mpeg .pdf .png .ppt .pptx .rar .rss .svg .tar .tgz .tif .tiff .tsv .wav .webm .webp .xls "
    ".xlsx .xml .zip"
).split()

# Elements that start and end a line of text.
BLOCK_TAGS = (
    "address article aside blockquote br dd div dl dt figcaption footer h1 h2 h3 h4 h5 h6 header "
    "hr li main nav ol p pre section table td th tr ul"
).split()

# Elements whose content is never text.
SKIP_TAGS = "script style template".split()

# URL schemes for which a relative reference is resolved, and for which ";params" is split off the
# last path segment (both as in the Python standard library).
RELATIVE_SCHEMES = (
    "file ftp gopher http https imap mms nntp prospero rtsp rtsps rtspu sftp shttp svn svn+ssh "
    "wais ws wss"
).split()
PARAM_SCHEMES = "ftp hdl http https imap mms prospero rtsp rtsps rtspu sftp shttp sip sips tel".split()

# Reasons a URL is left out.
BINARY = "binary-extension"
QUERY_HEAVY = "query-heavy"
DENIED = "deny-pattern"
NOT_ALLOWED = "allow-pattern-miss"
EXTERNAL = "external-host"
ROBOTS = "robots-disallow"
FETCH_FAILED = "fetch-failed"
NON_HTML = "non-html"
BAD_START = "invalid-start-url"
BAD_URL = "invalid-url"
SITEMAP_UNREADABLE = "sitemap-unreadable"

# Extraction limits.
MIN_TEXT_CHARS = 400
TITLE_BONUS = 200
PENALTY_MIN_LINES = 4
PENALTY_RATIO = 0.85
PENALTY_MAX_CHARS = 1200

# Crawl limits.
DEFAULT_MAX_PAGES = 200
HARD_MAX_PAGES = 500
MAX_QUERY_PARAMS = 3
MAX_QUERY_CHARS = 80
SITEMAP_INDEX_DEPTH = 2

# Warnings.
NO_TEXT_WARNING = "No extraction strategy returned text."

# Names of the non-strategy candidates.
METADATA_CANDIDATE = "bare_extraction"
API_CANDIDATE = "apiary_embed_json"
API_EMBED_MARK = "Apiary.Embed"

# Where a configuration that is no JSON names its API description: which pages have one depends on this exact pattern.
API_SUBDOMAIN = r"""["']?subdomain["']?\s*:\s*["']([^"']+)["']"""
