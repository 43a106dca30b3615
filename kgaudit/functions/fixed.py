"""Fixed values shared by the corpus operators: languages, folders, signatures."""

# Language of a file extension.
EXTENSION_LANGUAGES = {
    ".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript",
    ".cs": "csharp", ".go": "go", ".kt": "kotlin", ".rb": "ruby", ".rs": "rust", ".cpp": "cpp", ".c": "c", ".h": "c",
    ".hpp": "cpp", ".scala": "scala", ".swift": "swift", ".php": "php", ".pas": "delphi", ".dpr": "delphi",
    ".dfm": "delphi", ".inc": "delphi", ".cbl": "cobol", ".cob": "cobol", ".rpg": "rpg", ".rpgle": "rpg",
    ".nat": "natural", ".foc": "focus",
}
# Folders that a source scan leaves out.
IGNORED_FOLDERS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".idea", ".vs", "bin", "obj", "target"]
# File names and extensions that are not source code.
SKIPPED_NAMES = [
    "readme", "license", "licence", "makefile", "dockerfile", "changelog", "contributing", "authors",
    ".gitignore", ".gitattributes", ".editorconfig", ".env", ".env.example", "repo-metadata.txt",
]
SKIPPED_EXTENSIONS = [
    ".md", ".txt", ".json", ".xml", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".csv", ".log", ".lock", ".svg",
    ".png", ".jpg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib", ".o", ".a",
    ".class", ".jar", ".war", ".pyc", ".pyo", ".whl", ".egg",
]
# Words that show the language of a file without a known extension.
LANGUAGE_SIGNATURES = {
    "natural": ["DEFINE DATA", "END-DEFINE", "DEFINE SUBROUTINE", "END-SUBROUTINE", "DEFINE FUNCTION", "CALLNAT", "PERFORM ", "RESET ", "FETCH ", "INPUT USING MAP"],
    "cobol": ["IDENTIFICATION DIVISION", "DATA DIVISION", "PROCEDURE DIVISION", "WORKING-STORAGE SECTION", "PERFORM ", "EVALUATE ", "MOVE "],
    "rpg": ["DCL-PROC ", "END-PROC", "DCL-S ", "DCL-DS ", "BEGSR ", "ENDSR", "DCL-PI ", "CALLP "],
    "focus": ["TABLE FILE", "-DEFINE FUNCTION", "-DEFINE FILE", "GRAPH FILE", "-IF ", "-ENDIF"],
}
# Parts of a function name that point to database access.
DB_NAME_PARTS = ["SELECT", "INSERT", "UPDATE", "DELETE", "EXECUTE", "SqlCommand", "SqlConnection", "DbCommand", "ExecuteReader", "ExecuteNonQuery", "ExecuteScalar", "FROM ", "JOIN "]
