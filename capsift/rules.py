"""Rule tables: patterns, word lists and caps, kept as data.

Everything in this module is a FIXED VALUE: results are only right when these
match the formats being read, so they are stated plainly and in one place.
Patterns use the Java dialect.  ``(?<![A-Za-z0-9_])`` / ``(?![A-Za-z0-9_])``
stand for an ASCII word boundary, because Java's own one follows Unicode.
"""

from __future__ import annotations

WB = r"(?<![A-Za-z0-9_])"  # boundary before a word
WE = r"(?![A-Za-z0-9_])"  # boundary after a word

# --- text -------------------------------------------------------------------
CHARS_PER_TOKEN = 4
LINE_WIDTH = 80
SNIPPET_WIDTH = 120
EXEMPLAR_WIDTH = 100
PATH_WIDTH = 50

# --- log line normalisation, applied in this order ---------------------------
LOG_TIMESTAMP = r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*\s*"
LOG_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LOG_HEX = r"0x[0-9a-fA-F]+"
LOG_NUMBER = WB + r"\d{4,}" + WE
LOG_PATH = r"/[A-Za-z0-9_./\-]+"
LOG_TOP = {"error": 10, "warn": 5}

# --- generic cuts --------------------------------------------------------------
GENERIC_PASS, GENERIC_HEAD, GENERIC_TAIL = 40, 20, 10
SUMMARY_EDGE = 3
READ_PASS, READ_HEAD, READ_TAIL = 200, 80, 40
HEAD_MODE_LINES = 50
SIGNATURE_FALLBACK = 30
SIGNATURES = (
    r"^\s*(export\s+)?(async\s+)?(function|class|const\s+[A-Za-z0-9_]+\s*=|def |fn |pub fn |interface |type |struct |impl )",
    r"^\s*(public|private|protected)\s+(static\s+)?(async\s+)?[A-Za-z0-9_<>\[\]]+\s+[A-Za-z0-9_]+\s*\(",
)

# --- command routing: first match wins, command lower-cased and trimmed ---------
ROUTES = (
    ("git-status", r"^git\s+status"),
    ("git-log", r"^git\s+log"),
    ("git-diff", r"^git\s+diff"),
    ("git-simple", r"^git\s+(push|pull|add|commit)"),
    ("gradle-tasks", r"gradlew?\s+.*tasks"),
    ("gradle", r"gradlew?\s"),
    ("logcat", r"^adb\s+logcat"),
    ("adb-devices", r"^adb\s+devices"),
    ("adb-install", r"^adb\s+install"),
    ("test", WB + r"(test|pytest|jest|vitest|mocha|cargo\s+test|go\s+test|rspec|connectedandroidtest|testdebug|testrelease)" + WE),
    ("build", WB + r"(build|compile|tsc|eslint|biome|clippy|ruff|golangci-lint|prettier|assembledebug|assemblerelease|lintdebug|lintrelease)" + WE),
    ("ls", r"^(ls|dir)" + WE),
    ("find", r"^(find|fd)" + WE),
    ("grep", r"^(grep|rg|ag)" + WE),
    ("docker", r"^docker\s+(ps|images)"),
    ("logs", r"^(docker\s+logs|kubectl\s+logs|cat\s+.*\.log|tail\s)"),
)
JSON_COMMAND = WB + "json" + WE
SEARCH_PATTERN = r"""(?:grep|rg|ag)\s+(?:-\S+\s+)*["']?([^"'\s]+)["']?"""

#: (handler, pattern that selects it, pattern whose match is removed to leave the rest)
HANDLERS = (
    ("git", r"^git\s+(status|log|diff|add|commit|push|pull)", r"^git\s+"),
    ("cargo", r"^cargo\s+(test|build|clippy)", r"^cargo\s+"),
    ("pytest", r"^pytest(\s|$)", r"^pytest\s*"),
    ("go", r"^go\s+(test|build|vet)", r"^go\s+"),
    ("npm", r"^npm\s+(run|install|ci)", r"^npm\s+"),
    ("pnpm", r"^pnpm\s+", r"^pnpm\s+"),
    ("tsc", r"^tsc(\s|$)", r"^tsc\s*"),
    ("lint", r"^(eslint|biome)\s+", None),
    ("ruff", r"^ruff\s+(check|format)", r"^ruff\s+"),
    ("golangci", r"^golangci-lint\s+", r"^golangci-lint\s+"),
    ("docker", r"^docker\s+(ps|images|logs)", r"^docker\s+"),
    ("kubectl", r"^kubectl\s+(get|logs|describe)", r"^kubectl\s+"),
    ("gh", r"^gh\s+(pr|issue|run)\s+(list|view)", r"^gh\s+"),
    ("ls", r"^(ls|dir)(\s|$)", r"^(ls|dir)\s*"),
    ("grep", r"^(grep|rg)\s+", None),
    ("find", r"^(find|fd)\s+", r"^(find|fd)\s+"),
    ("json", r"^cat\s+.*\.json", r"^cat\s+"),
)
#: (reader, pattern that selects it): first match wins, command trimmed
TOOL_READERS = (
    ("git-status", r"^git\s+status"),
    ("git-log", r"^git\s+log"),
    ("git-diff", r"^git\s+diff"),
    ("git-simple", r"^git\s+(add|commit|push|pull)"),
    ("cargo", r"^cargo\s+test"),
    ("build", r"^cargo\s+(build|clippy)"),
    ("pytest", r"^pytest(\s|$)"),
    ("go", r"^go\s+test"),
    ("build", r"^go\s+(build|vet)"),
    ("npm", r"^npm\s+(run|install|ci)"),
    ("pnpm", r"^pnpm\s+"),
    ("tsc", r"^(npx\s+)?tsc(\s|$)"),
    ("lint", r"^(npx\s+)?(eslint|biome)\s+"),
    ("ruff", r"^ruff\s+(check|format)"),
    ("golangci", r"^golangci-lint\s+"),
    ("docker", r"^docker\s+ps"),
    ("docker-images", r"^docker\s+images"),
    ("logs", r"^docker\s+logs"),
    ("logs", r"^kubectl\s+logs"),
    ("kubectl", r"^kubectl\s+(get|describe)"),
    ("gh", r"^gh\s+(pr|issue|run)\s+(list|view)"),
    ("ls", r"^(ls|dir)(\s|$)"),
    ("grep", r"^(grep|rg)\s+"),
    ("find", r"^(find|fd)\s+"),
    ("json", r"^cat\s+.*\.json"),
    ("vitest", r"^npx\s+vitest(\s|$)"),
    ("playwright", r"^npx\s+playwright(\s|$)"),
    ("next", r"^(npx\s+)?next\s"),
    ("prettier", r"^(npx\s+)?prettier\s"),
    ("pip", r"^pip3?\s"),
    ("prisma", r"^(npx\s+)?prisma\s"),
    ("curl", r"^curl\s"),
    ("env", r"^(env|printenv)(\s|$)"),
    ("diff", r"^diff\s"),
)
#: the command whose output is a log; the tool's name goes in
LOGS_OF = r"^\s*(%s\s+)?(-\S+[\s=]+\S+\s+)*logs(\s|$)"
GREP_ARGS = r"""(?:grep|rg)\s+(?:-\S+\s+)*["']?([^"'\s]+)["']?\s*(.*)"""

# --- command audit ---------------------------------------------------------------
ALLOWED_PREFIXES = (
    "git",
    "npm", "npx", "node", "pnpm", "yarn",
    "tsc", "eslint", "biome", "prettier",
    "cargo", "rustc",
    "go", "golangci-lint",
    "pytest", "python", "python3", "pip", "pip3", "ruff",
    "vitest", "jest", "mocha",
    "playwright",
    "docker", "docker-compose", "kubectl", "helm",
    "gh",
    "curl", "wget",
    "gradle", "gradlew", "./gradlew",
    "adb",
    "prisma",
    "next", "vite", "webpack", "esbuild",
    "rg", "grep", "find", "fd",
    "ls", "dir", "cat", "head", "tail", "echo", "type",
    "diff",
    "env", "printenv",
)
QUOTED_SPAN = r"""'[^']*'?|"(?:\\[\s\S]|[^"\\])*"?"""
SHELL_TOKEN = r"(;|&&|&|\|\||\||<\(|>\(|[<>]|`|\$\()"
#: token -> (rule, reason)
SHELL_RULES = {
    ";": ("semicolon", "';' outside quotes chains commands"),
    "&&": ("and_and", "'&&' outside quotes chains commands"),
    "&": ("ampersand", "'&' outside quotes separates commands"),
    "||": ("or_or", "'||' outside quotes chains commands"),
    "|": ("pipe", "pipe outside quotes"),
    "<(": ("process_substitution_in", "process substitution '<('"),
    ">(": ("process_substitution_out", "process substitution '>('"),
    "<": ("redirect", "redirect outside quotes"),
    ">": ("redirect", "redirect outside quotes"),
    "`": ("backtick", "backtick substitution"),
    "$(": ("command_substitution", "command substitution '$('"),
}

# --- noise ------------------------------------------------------------------------
NOISE_DIRS = (
    "node_modules", ".git", "target", "__pycache__", ".next", "dist", "build",
    ".cache", ".turbo", ".vercel", ".pytest_cache", ".mypy_cache", ".tox",
    ".venv", "venv", "coverage", ".nyc_output", ".DS_Store", "Thumbs.db",
    ".idea", ".vscode", ".vs", ".eggs",
)
STATUS_HINT = r"""^\(use "git|^\(create/copy files|use "git add|use "git restore"""
NPM_NOISE = r"^(npm (warn|notice)|WARN|notice)"
NPM_SPINNER = r"^[⠀-⣿]"
NPM_ERROR = r"(?i)npm ERR!"
NPM_SUMMARY = r"added|removed|updated|audited|packages"
NPM_ERROR_CAP, NPM_SUMMARY_CAP = 20, 5
PNPM_NOISE = r"^(Progress|Packages|WARN)"
PNPM_DEPENDENCY = r"^\s+[A-Za-z0-9_@]|^[└├─│]"
PNPM_SUMMARY = r"packages?\s+\d"
PNPM_PASS, PNPM_CAP = 30, 30
PIP_NOISE = r"^(WARNING|DEPRECATION|Requirement already)"
PIP_PASS, PIP_CAP = 30, 20
PRISMA_BOX = r"^[┌┐└┘│├┤┬┴┼─═╔╗╚╝║╠╣╦╩╬▓░▌▐▄▀■]+$"
PRISMA_RULE = r"^[*#=\-]{5,}$"
PRISMA_KEEP = r"(?i)error|warn|Migration|Generated|Prisma Client|model |Running"
PRETTIER_BANNER = r"Checking formatting|All matched"
PRETTIER_CAP = 20

# --- environment --------------------------------------------------------------------
SECRET_NAME = r"(?i)key|token|secret|password|passwd|credential|auth|api_key|access|private"
MASK = "***masked***"
ENV_WIDTH, ENV_KEEP = 80, 77
INLINE_SECRET = (
    r"""(?i)((?:key|token|secret|password|passwd|credential|auth|access|private)[A-Za-z0-9_.\-]*\s*[=:]\s*)"""
    r"""("[^"\n]*"|'[^'\n]*'|[^\s"',;]+)"""
)

# --- builds ---------------------------------------------------------------------------
BUILD_ERROR = r"(?i)error(\[|:|\s)"
BUILD_WARNING = r"(?i)warning(\[|:|\s)"
BUILD_CAPS = {"error": 30, "warning": 10}
GRADLE_RESULT = r"^BUILD (SUCCESSFUL|FAILED)"
GRADLE_TIME = r"^Total time:|in\s+\d+[ms]"
GRADLE_ERROR = r"(?i)^e:|error:|FAILURE:|ERROR"
GRADLE_WARNING = r"(?i)^w:|warning:"
GRADLE_FAILED_TASK = r"^> Task .*(FAILED)"
GRADLE_CAPS = {"failed_task": 10, "error": 30, "warning": 10}
GRADLE_WARNING_SHORT = 5
NEXT_PROGRESS = r"^[▲◆○●]\s+|^(Compiling|Compiled|Creating|Building|Generating|Linting)\s"
NEXT_ROUTE = r"Route \(|Pages\s+\(|\s+Size\s+|\s+First Load"
NEXT_TICK = r"✓|✔"
NEXT_DONE = r"(?i)compiled|linted"
NEXT_ERROR = r"(?i)error:"
NEXT_WARNING = r"(?i)warn:"
NEXT_CAPS = {"error": 20, "warning": 10}

# --- logcat -----------------------------------------------------------------------------
LOGCAT_FATAL = r"(?i)" + WB + r"F/|FATAL"
LOGCAT_CRASH = r"(?i)AndroidRuntime|FATAL EXCEPTION|ANR in|Process:.*died"
LOGCAT_ERROR = r"(?i)" + WB + r"E/|ERROR"
LOGCAT_WARNING = r"(?i)" + WB + r"W/|WARN"
LOGCAT_CAPS = {"fatal": 20, "error": 20, "warning": 10}
LOGCAT_PASS, LOGCAT_RECENT = 20, 10

# --- missing commands ---------------------------------------------------------------------
#: A whole text that only says so; the same words inside a longer output are no sign.
NOT_FOUND_TEXT = (r"^\s*(\S+: (line )?(\d+: )?\S+: (command )?not found|zsh: command not found: \S+"
                  r"|'?[^'\n]+'? is not recognized as [^\n]*(\noperable program or batch file\.)?)\s*$")

# --- tests --------------------------------------------------------------------------------
TEST_CAP = 20
PASSED = r"(\d+)\s+passed"
FAILED = r"(\d+)\s+failed"
JEST_SUMMARY = r"Tests:\s.*\d+\s+total"
JEST_TOTAL = r"(\d+)\s+total"
CARGO_SUMMARY = r"test result:\s+([A-Za-z0-9_]+)\.\s+(\d+) passed;\s+(\d+) failed"
CARGO_FAILURE = r"^test .+ \.\.\. FAILED|^FAILED|^thread '.+' panicked"
GENERIC_FAILURE = r"(?i)FAIL|FAILED|ERROR|panic|AssertionError|assert"
PYTEST_RULE = "====="
PYTEST_BLOCK_OPEN = r"^_{5,} "
PYTEST_BLOCK_CLOSE = r"^={5,}"
PYTEST_ASSERT = r"AssertionError|assert |E\s+"
GO_JSON = '"Action"'
GO_FAIL_TEST = r"^--- FAIL:"
GO_PASS_TEST = r"^--- PASS:"
GO_FAIL_PACKAGE = r"^FAIL\s"
GO_PASS_PACKAGE = r"^ok\s"
VITEST_SUMMARY = r"Tests\s+\d+ (failed|passed)"
VITEST_PASS = r"✓|PASS"
VITEST_FAIL = r"×|✗|FAIL"
VITEST_DETAIL = r"AssertionError|Expected|Received"
PLAYWRIGHT_SUMMARY = r"\d+ (passed|failed)"
PLAYWRIGHT_PASS = r"✓|passed"
PLAYWRIGHT_TIMING = r"ms|s\)"
PLAYWRIGHT_FAIL = r"✗|failed|FAILED"
PLAYWRIGHT_DETAIL = r"expect|Error:"

# --- diagnostics ------------------------------------------------------------------------------
TSC = r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)"
ESLINT = r"^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s+([A-Za-z0-9_/@\-]+)$"
BIOME = r"^(.+?) (\d+):(\d+) ━+\s+(.+)$"
RUFF = r"^(.+?):(\d+):(\d+): ([A-Z]\d+) (.+)$"
PER_FILE_CAP, PER_RULE_CAP, PER_LINTER_CAP = 10, 5, 5
RUFF_SCHEMA = "array<struct<filename:string,message:string,code:string,location:struct<row:bigint,column:bigint>>>"
GOLANGCI_SCHEMA = "struct<Issues:array<struct<FromLinter:string,Text:string,Pos:struct<Filename:string,Line:bigint>>>>"

# --- search results, listings, tables ---------------------------------------------------------
GREP_DRIVE = r"^[A-Za-z]:[\\/]"
GREP_ROW = r"^(\d+):"
GREP_PER_FILE, GREP_OVERALL = 5, 50
FIND_PASS, FIND_ALL, FIND_HEAD = 30, 5, 3
EXT_CAP = 5
WINDOWS_DIR = r"<DIR>\s+(.+)$"
WINDOWS_FILE_LINE = r"^\S+\s.*?\s([\d,]+)\s+(\S.+)$"
LS_LINE = r"^[dl\-][rwxsStT\-]{9}"
WINDOWS_LINE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\s"
TASK_CAP = 8
TABLE_HEADERS = {
    "docker_ps": r"^CONTAINER ID\s",
    "docker_images": r"^REPOSITORY\s+TAG\s",
    "kubectl": r"^(NAMESPACE\s+)?NAME(\s{2,}[A-Z][A-Z()\- ]*)+\s*$",
}

# --- version control ----------------------------------------------------------------------------
STATUS_LINE = r"^(##|[MADRCU?!][ MADRCU?!] |[ ][MADRCU?!] )"
STATUS_CONFLICTS = ("DD", "AU", "UD", "UA", "DU", "AA", "UU")
STATUS_CAPS = {"branch": 1, "staged": 10, "modified": 10, "untracked": 5, "conflict": 1}
LOG_BLOCK_END = "---END---"
LOG_TRAILER = r"^(Signed-off-by:|Co-authored-by:)"
LOG_COMMIT = r"^commit\s+([a-f0-9]+)"
LOG_ONELINE = r"^([a-f0-9]{7,})\s+(.+)"
#: a line of either kind, or an indented one that is not blank
LOG_EVENT = r"^(commit\s+[a-f0-9]|[a-f0-9]{7,}\s+.| {4}(?s:.*)\S)"
DIFF_HUNK_CAP, DIFF_CAP = 30, 200
COMMIT_REF = r"\[[A-Za-z0-9_/.\-]+\s+([a-f0-9]+)\]"
INSTALL_FAILURE = r"Failure \[(.+)\]"
INSTALL_TAIL, SIMPLE_HEAD = 3, 5

# --- JSON, ledger ------------------------------------------------------------------------------
JSON_DEPTH = 3
LEDGER_DAYS, LEDGER_HISTORY, COMMAND_WIDTH = 30, 20, 60
FAILURES_KEPT = 20
#: published typical savings in percent, lowest and highest
SAVINGS_BANDS = {
    "git-status": (75, 92), "git-log": (75, 92), "git-diff": (75, 92), "git-simple": (75, 92),
    "diff": (70, 70),
    "test": (90, 90), "pytest": (90, 90), "vitest": (90, 90), "playwright": (90, 90),
    "cargo": (80, 80), "go": (80, 80),
    "build": (80, 80), "gradle": (80, 80),
    "tsc": (85, 85), "lint": (85, 85), "ruff": (85, 85), "golangci": (85, 85),
    "ls": (80, 80), "find": (60, 60), "grep": (80, 80),
    "json": (85, 85), "read": (50, 70), "summary": (70, 70),
}
