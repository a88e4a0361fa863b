"""Fixed values of the architecture model: role and dependency names, lists of ignored types, rules, folders."""

from __future__ import annotations

#: Roles of a class, in the order of reports.
COMPONENT_TYPES = (
    "CONTROLLER", "SERVICE", "REPOSITORY", "ENTITY", "DTO", "CONFIGURATION", "APPLICATION", "COMPONENT", "EXCEPTION", "EXCEPTION_HANDLER",
    "FILTER", "SECURITY", "UNKNOWN",
)
#: Kinds of a dependency; the first three are extracted.
DEPENDENCY_TYPES = ("FIELD", "CONSTRUCTOR", "METHOD_PARAMETER", "METHOD_RETURN", "INHERITANCE", "IMPLEMENTATION", "GENERIC", "METHOD_CALL")
#: Annotation name and role; an earlier row wins.
ANNOTATION_ROLES = (
    ("RestController", "CONTROLLER"), ("Controller", "CONTROLLER"), ("Service", "SERVICE"), ("Repository", "REPOSITORY"), ("Entity", "ENTITY"),
    ("Configuration", "CONFIGURATION"), ("Component", "COMPONENT"), ("RestControllerAdvice", "EXCEPTION_HANDLER"),
    ("ControllerAdvice", "EXCEPTION_HANDLER"), ("SpringBootApplication", "APPLICATION"),
)
SUPERCLASS_ROLES = {"RuntimeException": "EXCEPTION", "Exception": "EXCEPTION", "OncePerRequestFilter": "FILTER"}
INTERFACE_ROLES = (("JpaRepository", "REPOSITORY"), ("UserDetailsService", "SERVICE"))
#: Name suffix and role of classes; an earlier row wins. An interface has a role by its name only if it ends in Repository.
SUFFIX_ROLES = (
    ("Controller", "CONTROLLER"), ("ServiceImpl", "SERVICE"), ("Repository", "REPOSITORY"), ("Entity", "ENTITY"), ("Dto", "DTO"), ("Request", "DTO"),
    ("Response", "DTO"), ("Exception", "EXCEPTION"), ("Config", "CONFIGURATION"), ("Configuration", "CONFIGURATION"),
)
PACKAGE_ROLES = {
    "controller": "CONTROLLER", "service": "SERVICE", "repository": "REPOSITORY", "entity": "ENTITY", "dto": "DTO", "exception": "EXCEPTION", "config": "CONFIGURATION",
}
PRIMITIVES = ("int", "long", "double", "float", "boolean", "char", "byte", "short")
#: Types that never enter the graph.
IGNORED_TYPES = (
    "String", "Object", "Integer", "Long", "Double", "Float", "Boolean", "Character", "Byte", "Short",
    "List", "Set", "Map", "Collection", "Optional", "Iterable",
    "LocalDate", "LocalDateTime", "LocalTime", "Date", "Instant",
    "ResponseEntity", "MultipartFile", "Model", "ModelMap", "BindingResult", "WebRequest",
    "Authentication", "AuthenticationManager", "AuthenticationConfiguration", "AuthenticationEntryPoint", "PasswordEncoder", "GrantedAuthority",
    "UserDetails", "UserDetailsService", "HttpServletRequest", "HttpServletResponse", "FilterChain", "HttpSecurity",
    "ConstraintViolationException", "MethodArgumentNotValidException", "Throwable", "Exception", "RuntimeException", "Error",
    "AccessDeniedException", "BadCredentialsException", "Key",
)
#: Layer rules: source role, target role, allowed. Pairs without a rule are allowed.
LAYER_RULES = (
    ("CONTROLLER", "SERVICE", True), ("CONTROLLER", "DTO", True), ("CONTROLLER", "REPOSITORY", False), ("CONTROLLER", "ENTITY", False),
    ("SERVICE", "REPOSITORY", True), ("SERVICE", "ENTITY", True), ("SERVICE", "DTO", True),
    ("REPOSITORY", "ENTITY", True), ("REPOSITORY", "CONTROLLER", False), ("REPOSITORY", "DTO", False),
    ("ENTITY", "CONTROLLER", False), ("ENTITY", "SERVICE", False), ("DTO", "REPOSITORY", False), ("DTO", "ENTITY", True),
)
COUNTED_LAYERS = ("CONTROLLER", "SERVICE", "REPOSITORY", "ENTITY", "COMPONENT", "CONFIGURATION")
#: Roles and the folder kind of their classes; other roles and none go to COMMON. Folder kinds and their directory names.
ROLE_FOLDERS = {
    "CONTROLLER": "CONTROLLER", "SERVICE": "SERVICE", "REPOSITORY": "REPOSITORY", "ENTITY": "ENTITY", "DTO": "DTO", "CONFIGURATION": "CONFIGURATION",
    "COMPONENT": "COMPONENT", "EXCEPTION": "EXCEPTION", "EXCEPTION_HANDLER": "EXCEPTION",
}
FOLDER_NAMES = {
    "CONTROLLER": "controller", "SERVICE": "service", "REPOSITORY": "repository", "ENTITY": "entity", "DTO": "dto", "CONFIGURATION": "config",
    "COMPONENT": "component", "EXCEPTION": "exception", "COMMON": "common",
}
#: Parts of a class name that the naming heuristic removes, in this order.
NAME_PARTS = ("Controller", "ServiceImpl", "Service", "Repository", "Entity", "Dto", "DTO", "Request", "Response", "Config", "Configuration", "Exception")
MAX_ARCHIVE_BYTES = 500 * 1024 * 1024
#: Kinds of errors and their HTTP status.
ERRORS = {
    "InvalidZip": 400, "InvalidProjectStructure": 400, "SourceCodeNotFound": 400, "JavaParsing": 400,
    "ProjectExtraction": 500, "WorkspaceCreation": 500, "ArchiveStorage": 500,
}
