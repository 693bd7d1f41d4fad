"""Word lists, tables and formats that results depend on, stated as they are."""

from __future__ import annotations

# --- fixed values: Korean names ---------------------------------------------

SURNAMES = (
    "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설마길연위표명기반라왕금옥육인맹제모탁국어은편용예경봉사부가복태목형피두감음빈동온호범좌팽승간상갈단견당화창"
)
ROLE_WORDS = (
    "지도교수", "담당교수", "책임교수", "주임교수", "겸임교수", "객원교수", "부교수", "정교수", "조교수",
    "석좌교수", "명예교수", "초빙교수", "연구교수", "전임교수", "지도박사", "담당박사", "박사후연구원",
    "담당선생", "학과선생", "담임선생", "책임연구원", "선임연구원", "수석연구원", "전임연구원", "위촉연구원",
    "대학원생", "학부생", "연구원", "학생", "교수", "박사", "선생",
)
NOT_NAMES = (
    "완료", "확인", "예정", "없음", "미정", "필요", "진행", "요청", "검토", "담당", "작성", "승인", "대기",
    "본인", "전체", "공통", "각자", "팀장", "부서", "관리", "센터", "없다", "해당", "기타", "미상",
    "신입", "신규", "인턴", "막내", "선배", "후배", "동료", "전임", "수석", "책임", "선임", "주니어",
    "시니어", "초보", "여러", "모든", "각각", "다른", "우리", "저희", "같은", "새로운", "외부", "내부",
    "객원", "명예", "전공", "지도", "담임", "원로", "현직", "전직", "예비", "정규",
)
TITLES = "교수|박사|선생|연구원|원장|소장|팀장|실장|부장|과장|차장|대리|주임|사원|학생|씨"
PARTICLES = "님|께서|께|에게서|에게|한테|이|가|은|는|을|를|과|와|의|도|만"
#: What may follow a known name at once.
NAME_FOLLOWERS = "이|가|은|는|을|를|의|와|과|도|만|께|에|한테|랑|로|으로|님|씨|군|양|네|측|쪽|입니|였|선배|후배|교수|박사|선생|학생|연구원|팀장|실장|과장|대리|부장|형|누나|언니|오빠"
NAME_LABELS = "담당자?|검토자?|작성자?|저자|책임자|연락처|이름|성명|성함|보호자|신청인|대표자?|승인자?|결재자?|수신인?|발신인?|참석자?|참여자|명단|구성원|위원"

# --- fixed values: cues and parts of Korean identifiers -----------------------

BANK_CUES = "계좌|은행|농협|국민|신한|우리|하나|기업|카카오뱅크|케이뱅크|토스|새마을|우체국|수협|신협|account"
PASSPORT_CUES = "여권|passport"
LICENCE_CUES = "면허|license"
RESIDENT_CUES = "주민|외국인등록|resident|RRN"
BUSINESS_CUES = "사업자|business"
BIRTH_CUES = "생년월일|생일|DOB|date of birth"
ID_CUES = "학번|사번|직번|교번|교직원\\s?번호|student\\s?(?:id|no\\.?|number)|employee\\s?(?:id|no\\.?|number)"
PROVINCES = "서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주"
ADDRESS_PROVINCES = "서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충청북|충청남|충북|충남|전라북|전라남|전북|전남|경상북|경상남|경북|경남|제주"
PLATE_SYLLABLES = "가나다라마거너더러머버서어저고노도로모보소오조구누두루무부수우주아바사자배하허호"
RESIDENT_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
BUSINESS_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)

# --- fixed values: addresses and accounts that name nobody --------------------

EMAIL_LOCALS = ("git", "noreply", "no-reply")
EMAIL_LABELS = ("example", "test", "localhost", "domain", "email", "company")
EMAIL_SUFFIXES = (".example", ".test", ".invalid", ".local", "noreply.github.com")
GENERIC_USERS = (
    "user", "users", "username", "you", "yourname", "your_name", "me", "name", "public",
    "default", "default user", "all users", "shared", "runner", "ubuntu", "vagrant",
    "docker", "admin", "guest", "someone", "foo", "example", "x", "...", "*", "~",
    "runneradmin", "appveyor", "vssadministrator", "buildagent", "jenkins", "travis",
    "circleci", "builder", "build", "ci",
)
GENERIC_TENANTS = ("personal", "개인")
EXAMPLE_IPS = ("10.0.0.1", "10.0.0.2", "10.0.0.0", "192.168.0.1", "192.168.1.1", "192.168.0.0", "192.168.1.0", "172.16.0.1", "172.16.0.0")
GENERIC_AUTHORS = ("user", "admin", "administrator", "author", "unknown", "microsoft office user", "microsoft office 사용자", "python-docx", "openpyxl", "python-pptx", "windows 사용자")
PERSON_KEYS = ("creator", "lastModifiedBy", "Author", "author", "initial-creator", "Manager", "manager", "LastSavedBy")
PERSON_ATTRIBUTES = ("author", "initials", "userId", "creator", "displayName")

# --- fixed values: documentation filler ----------------------------------------

FILLER_WORDS = (
    "your", "yours", "yourkey", "yourapikey", "my", "mykey",
    "api", "key", "keys", "apikey", "token", "secret", "password", "pass", "here",
    "example", "examples", "placeholder", "changeme", "dummy", "fake", "redacted",
    "test", "sample", "replace", "insert", "todo", "none", "null", "value",
    "xxx", "xxxx", "abc", "abcdef", "foo", "bar", "baz", "qux", "demo",
)
CODE_MARKERS = ("...", "<", ">", "${", "$(", "{{", "os.environ", "getenv", "process.env", "env(", "env:", "secrets.", "vault:", "op://", "[redacted", "***")
VENDOR_PREFIX = "(?i)^(?:sk-(?:ant-(?:api\\d+-)?|or-v\\d+-|proj-)?|sk_(?:live|test)_|ghp_|gho_|ghs_|github_pat_|glpat-|xox[baprs]-|hf_|ntn_|secret_|AKIA|AIza|SG\\.)"

# --- fixed values: files --------------------------------------------------------

SKIPPED_FOLDERS = (".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".eggs")
ZIPPED = (".docx", ".docm", ".dotx", ".xlsx", ".xlsm", ".pptx", ".pptm", ".odt", ".ods", ".odp", ".hwpx")
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp")
OPAQUE = (".doc", ".xls", ".ppt", ".hwp", ".rtf", ".zip", ".7z", ".rar", ".gz", ".tgz", ".bz2", ".xz", ".db", ".sqlite", ".sqlite3", ".msg", ".eml", ".pst")
BINARY = (
    ".ico", ".jar", ".whl", ".egg", ".so", ".dll", ".dylib", ".exe", ".bin", ".o", ".a", ".pyc", ".pyo", ".class",
    ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flac", ".ogg", ".ttf", ".otf", ".woff", ".woff2", ".npy", ".npz", ".pkl", ".parquet", ".h5",
)
#: Parts of office files that hold text, and office files inside office files.
TEXT_PARTS = (
    r"word/(?:document|comments[^/]*|header\d*|footer\d*|footnotes|endnotes|people)\.xml",
    r"word/charts/[^/]+\.xml",
    r"xl/(?:sharedStrings|worksheets/sheet\d+|comments\d*|threadedComments/[^/]+|persons/[^/]+|charts/[^/]+)\.xml",
    r"ppt/(?:slides/slide\d+|notesSlides/notesSlide\d+|comments/[^/]+|commentAuthors|authors|charts/[^/]+)\.xml",
    r"docProps/(?:core|app|custom)\.xml",
    r"Contents/(?:section\d+|content)\.(?:xml|hpf)",
    r"content\.xml|meta\.xml|styles\.xml",
)
EMBEDDED = r"(?:word|xl|ppt)/embeddings/[^/]+\.(?:docx|xlsx|pptx)"
PROPERTY_PARTS = ("core.xml", "app.xml", "custom.xml", "meta.xml", "content.hpf")
PARAGRAPH_TAGS = ("p", "h", "si", "row", "comment", "cm", "threadedComment")
TEXT_TAGS = ("t", "instrText", "f", "author", "text")

# --- fixed values: known secrets and redaction ----------------------------------

SECRET_NAMES = r"token|key|pat$|password|passwd|secret|credential|auth"
INFRA_TAGS = {
    "windows-home-path": "<USER>",
    "posix-home-path": "<USER>",
    "onedrive-tenant": "<ORG>",
    "private-ipv4": "<PRIVATE_IP>",
    "sharepoint-tenant": "<ORG>",
    "sharepoint-personal": "<USER>",
    "internal-host": "<INTERNAL_HOST>",
}
