"""Path classifiers as column expressions: ordered rules become one CASE, evaluated inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path rules of the index tiers.
EXCLUDED_DIRS = (
    "node_modules/", ".git/", "dist/", "build/", ".next/", ".nuxt/", ".turbo/", ".parcel-cache/", ".cache/", "coverage/", "__pycache__/", ".pytest_cache/", ".mypy_cache/", ".tox/",
    "target/", "vendor/", "venv/", ".venv/", ".idea/", ".vscode/", "storybook-static/", ".serverless/", "obj/", ".vs/", ".angular/", ".gradle/",
)
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "composer.lock", "Cargo.lock", "Gemfile.lock", "poetry.lock", "go.sum", "mix.lock")
EXCLUDED_SUFFIXES = (".tsbuildinfo", ".lock", ".lockb", ".min.js", ".min.css", ".min.mjs", ".bundle.js", ".chunk.js", ".map", ".snap", ".pyc", ".class", ".o", ".a")
MADE_DIRS = r"/(vendor|third[-_]party|generated|gen|__generated__)/"
ON_DEMAND = r"(^|/)__tests__/|(^|/)__mocks__/|(^|/)tests?/|\.test\.[jt]sx?$|\.spec\.[jt]sx?$|\.stories\.[jt]sx?$|\.fixture\.[jt]sx?$|(^|/)fixtures?/|(^|/)e2e/|(^|/)docs?/|(^|/)examples?/|(^|/)samples?/|\.md$|\.mdx$|(^|/)migrations?/"
CORE = r"/(server|router|routes|api|controllers?|services?|models?|stores?|providers?|schemas?|use[-_]cases?)/|/(index|main|app|server|client)\.[jt]sx?$|/types?\.[jt]sx?$"
OVERSIZED, PROMOTED_FROM = 1_000_000, 4
# Extension to language id.
LANGUAGES = {
    "typescript": ("ts", "cts", "mts", "tsx",), "javascript": ("js", "cjs", "mjs", "jsx",), "json": ("json",), "markdown": ("md", "markdown",), "css": ("css",), "scss": ("scss",), "less": ("less",),
    "html": ("html", "htm",), "vue": ("vue",), "svelte": ("svelte",), "xml": ("xml",), "yaml": ("yaml", "yml",), "toml": ("toml",), "python": ("py",), "ruby": ("rb",), "php": ("php",), "go": ("go",),
    "rust": ("rs",), "java": ("java",), "kotlin": ("kt", "kts",), "swift": ("swift",), "csharp": ("cs",), "cpp": ("cpp", "cc", "cxx", "hpp",), "c": ("c", "h",), "lua": ("lua",), "dart": ("dart",),
    "scala": ("scala",), "sql": ("sql",), "shell": ("sh", "bash",), "powershell": ("ps1",), "dockerfile": ("dockerfile",),
}
# File name conventions and the role they tell.
ROLES = (
    (r"\.module\.ts$", "Angular module"), (r"\.component\.ts$", "Angular component"), (r"\.directive\.ts$", "Angular directive"), (r"\.pipe\.ts$", "Angular pipe"), (r"\.guard\.ts$", "route guard"), (r"\.resolver\.ts$", "route resolver"),
    (r"\.(spec|test)\.[cm]?[tj]sx?$", "test"), (r"\.controller\.ts$", "controller"), (r"controller\.(cs|java|kt|php|rb|go)$", "controller"), (r"repository\.(cs|java|kt|php|rb|ts)$", "repository"), (r"dbcontext\.cs$", "repository"),
    (r"\.service\.ts$", "service"), (r"service\.(cs|java|kt|php|rb)$", "service"), (r"\.dto\.ts$", "DTO"), (r"(dto|viewmodel)\.(cs|java|kt|php)$", "DTO"), (r"\.model\.ts$", "model"), (r"(model|entity)\.(cs|java|kt|php|rb)$", "model"),
    (r"^models\.py$", "model"), (r"^views\.py$", "view"), (r"^serializers\.py$", "serializer"), (r"\.enum\.ts$", "enum"), (r"\.interface\.ts$", "interface"), (r"\.config\.[cm]?[tj]s$", "config"), (r"\.routes?\.ts$", "routes"), (r"\.store\.ts$", "store"),
)
# Layer rules by base name and by whole path, first match wins.
LAYERS = (
    ("test", r"\.(spec|test)\.[cm]?[tj]sx?$|(tests?|spec)\.(cs|java|kt|php|rb|go)$|^test_.*\.py$|_test\.(py|go)$", r"(^|/)(__tests__|tests?|e2e|specs?)/|\.tests?/", ("test",)),
    ("config", r"\.config\.[cm]?[tj]s$|^(tsconfig|jsconfig|package|vite\.config|webpack|rollup|esbuild|jest\.config|vitest\.config|babel|\.eslintrc|eslint\.config|\.prettierrc|\.editorconfig)|^appsettings(\.|$)|^(web|app)\.config$|\.(csproj|sln|props|targets|fsproj|vbproj)$|^application\.(ya?ml|properties)$|^(settings\.py|pyproject\.toml|setup\.py|setup\.cfg)$|^requirements.*\.txt$|^pipfile$|^go\.(mod|sum)$|^composer\.(json|lock)$|^pom\.xml$|^build\.gradle(\.kts)?$|^(settings\.gradle|gemfile|cargo\.toml)$|^\.env($|\.)", r"(^|/)config/", ()),
    ("infrastructure", r"^dockerfile|^docker-compose|\.(tf|tfvars|bicep)$|^(serverless\.ya?ml|wrangler\.toml|nginx\.conf)$", r"(^|/)(infra|infrastructure|deploy|deployment|docker|\.github|ci|cd|k8s|kubernetes|terraform|ops|pipelines?|helm|charts?|ansible)/", ()),
    ("data", r"(repository|entity|dao|dbcontext)\.(cs|java|kt|php|rb|go|py|ts|js)$|[._-](repository|model|entity|dto|schema|dao|serializer)\.[cm]?[tj]sx?$|^(models?|schemas?|serializers?|entities)\.py$|\.sql$", r"(^|/)(migrations?|entities|models?|repositories|repository|dao|store|stores|db|database|persistence|schemas?)/", ("repository", "model", "DTO")),
    ("presentation", r"\.(component|view|page)\.[cm]?[tj]sx?$|\.(tsx|jsx|vue|svelte|astro|cshtml|razor|erb)$|\.blade\.php$|^views\.py$", r"(^|/)(components?|views?|pages?|ui|screens?|widgets?|templates?|layouts?|wwwroot|public|partials?)/", ("Angular component", "React component")),
    ("business", r"(controller|service|usecase|use-case|handler|resolver|manager|facade|interactor)\.(cs|java|kt|php|rb|go|py|ts|js)$|[._-](service|controller|usecase|use-case|handler|resolver|manager|facade|middleware|validator|mapper)\.[cm]?[tj]sx?$", r"(^|/)(services?|controllers?|usecases?|use-cases?|handlers?|business|domain|logic|application)/", ("service", "controller")),
)
SOURCE = r"\.(c|cc|cpp|cxx|h|hpp|cs|java|kt|kts|swift|rb|php|py|go|rs|scala|dart|ts|tsx|js|jsx|mjs|cjs|m|mm|ex|exs|clj)$"
ENTRY_NAMES = r"^(main|cli|server|program)\.[cm]?[tj]sx?$|^(main|program)\.(py|go|rs|java|cs|kt)$|^(app\.module\.ts|program\.cs|startup\.cs|global\.asax|manage\.py|__main__\.py|wsgi\.py|asgi\.py|index\.php|artisan)$|application\.(java|kt)$"
ENTRY_PATHS = r"(^|/)(cli|bin)/index\.[cm]?[tj]sx?$|(^|/)cmd/[^/]+/main\.go$"
BINARY = r"\.(png|jpe?g|gif|bmp|ico|webp|pdf|zip|gz|tar|7z|rar|exe|dll|so|dylib|bin|woff2?|ttf|eot|otf|mp[34]|mov|avi|wasm|jar|war|sqlite|db|parquet)$"


def norm(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\\", "/"))


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def dirname(path: Column) -> Column:
    """The directory, '.' for a bare file name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty without one."""
    return F.regexp_extract(F.lower(basename(path)), r"\.([^.]*)$", 1)


def _inside(p: Column) -> Column:
    alternatives = "|".join(re.escape(d) for d in EXCLUDED_DIRS)
    return p.rlike(f"(^|/)({alternatives})")


def _suffixed(p: Column) -> Column:
    return p.rlike("(" + "|".join(re.escape(s) for s in EXCLUDED_SUFFIXES) + ")$")


def hard_excluded(path: Column) -> Column:
    """Never worth reading: lockfiles, build output, vendored or generated directories."""
    p = norm(path)
    return basename(p).isin(*LOCKFILES) | _suffixed(p) | _inside(p) | p.rlike(MADE_DIRS)


def index_tier(path: Column, size: Column) -> Column:
    """core, support, on_demand or excluded; the first rule that holds decides."""
    p = norm(path)
    gone = _inside(p) | basename(p).isin(*LOCKFILES) | _suffixed(p) | (size > OVERSIZED) | p.rlike(MADE_DIRS)
    return F.when(gone, "excluded").when(p.rlike(ON_DEMAND), "on_demand").when(p.rlike(CORE), "core").otherwise("support")


def promoted(tier: Column, indegree: Column) -> Column:
    """support becomes core from PROMOTED_FROM dependents on."""
    return F.when((tier == "support") & (F.coalesce(indegree, F.lit(0)) >= PROMOTED_FROM), "core").otherwise(tier)


def language_id(path: Column) -> Column:
    base, ext = F.lower(basename(path)), extension(path)
    out = F.when(base == "dockerfile", "dockerfile")
    for language, names in LANGUAGES.items():
        out = out.when(ext.isin(*names), language)
    return out.otherwise("plaintext")


def file_role(path: Column) -> Column:
    base = F.lower(basename(path))
    first, *rest = ROLES
    out = F.when(base.rlike(first[0]), first[1])
    for pattern, role in rest:
        out = out.when(base.rlike(pattern), role)
    return out.when(basename(path).rlike(r"^[A-Z].*\.[jt]sx$"), "React component")


def layer(path: Column, stored: Column) -> Column:
    """A stored layer other than unknown, else by conventions of names and directories."""
    p, role = norm(path), F.coalesce(file_role(path), F.lit(""))
    base = basename(p)
    out = F.when(stored.isin(*(name for name, *_ in LAYERS)), stored)
    for name, by_base, by_path, roles in LAYERS:
        hit = base.rlike(by_base) | p.rlike(by_path)
        out = out.when(hit | role.isin(*roles) if roles else hit, name)
    return out.when(base.rlike(SOURCE), "business").otherwise("unknown")


def entry_name(path: Column) -> Column:
    p = norm(path)
    return basename(p).rlike(ENTRY_NAMES) | p.rlike(ENTRY_PATHS)


def binary_name(path: Column) -> Column:
    return norm(path).rlike(BINARY)


def glob_pattern(glob: str) -> str:
    """A path glob (** across directories, * and ? within one, {a,b}, [..]) as an anchored regular expression."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            out, k = out + "[" + glob[k + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        if c == "{" and "}" in glob[k:]:
            end = glob.index("}", k)
            out, k = out + "(?:" + "|".join(re.escape(x) for x in glob[k + 1 : end].split(",")) + ")", end + 1
            continue
        out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return f"^{out}$"


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """Ignore-file lines as (pattern, whether it takes back), in order."""
    out = []
    for line in lines:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        rooted, directory = "/" in rule.rstrip("/"), rule.endswith("/")
        core = glob_pattern(rule.strip("/"))[1:-1]
        out.append((("^" if rooted else "(^|/)") + core + ("/" if directory else "(/|$)"), back))
    return out


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether ignore rules, in their order and with later ones winning, leave the path out."""
    out = F.lit(False)
    for pattern, back in ignore_rules(lines):
        out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out
