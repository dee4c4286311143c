"""Grammars of the languages whose files are checked, in the notation of `gll.Grammar`.

Terminals in brackets ('(args)', '{block}', ...) are bracket groups, folded to one token before the text around them is
read; the rules of `*_GROUPS` say which start symbol a group must derive to count as each of them.
"""

# --- JavaScript and TypeScript: one text; the lines marked TS: are left out for JavaScript, JS: for TypeScript ---------
SCRIPT = """
Stmts = Stmt*
Module = ModuleItem*
ModuleItem = Stmt | Import | Export
End = ';' | <nl>
Stmt = '{block}' | ';' | 'if' '(paren)' Stmt Else? | 'for' 'await'? '(for)' Stmt | 'while' '(paren)' Stmt | 'do' Stmt 'while' '(paren)' ';'?
Else = 'else' Stmt
Stmt = 'return' Expr? End | 'throw' Expr End | 'break' NAME? End | 'continue' NAME? End | 'debugger' End | 'with' '(paren)' Stmt
Stmt = 'try' '{block}' Handler | 'switch' '(paren)' '{switch}' | NAME ':' Stmt | Declared | Var End
Stmt = !'{' !'function' !'class' Expr End
Declared = Function | Class
Handler = Catch Finally? | Finally
Catch = 'catch' '(catch)'? '{block}'
Finally = 'finally' '{block}'
Var = ('var' | 'let') Binding (',' Binding)* | 'const' Constant (',' Constant)*
Binding = NAME Sure T Init? | Pattern T Init
Constant = (NAME | Pattern) T Init
Pattern = '{pattern}' | '[pattern]'
Target = NAME | Pattern
Init = '=' Assign
Function = 'async'? 'function' '*'? NAME TP '(params)' TRet '{block}'
Class = Decorator* 'class' NAME TP Heritage '{class}'
Heritage = ('extends' Lhs)?
Decorator = '@' NAME ('.' IDENT)* '(args)'?
Expr = Assign (',' Assign)*
Assign = Cond | Lhs AssignOp Assign | Arrow | 'yield' '*'? Assign | 'yield'
AssignOp = '=' | ASSIGN
Arrow = 'async'? NAME '=>' ArrowBody | 'async'? TP '(params)' TRet '=>' ArrowBody
ArrowBody = !'{' Assign | '{block}'
Cond = Bin Ternary?
Ternary = '?' Assign ':' Assign
JS: Bin = Unary (Op Unary)*
TS: Bin = Unary (Op2 | Op Unary)*
Op = BINOP | '*' | '+' | '-' | '/' | '<' | '|' | '&' | 'in' | 'instanceof' | '>~'? '>~'? '>'
Unary = ('+' | '-' | '!' | PREFIX | '++' | '--' | 'await' | 'typeof' | 'void' | 'delete')* Postfix
Postfix = Lhs ('++' | '--')?
Lhs = 'new'* Primary Tail*
Tail = '.' IDENT | '.' PRIVATE | '?.' (IDENT | '(args)' | '[index]' | PRIVATE) | '(args)' | '[index]' | TEMPLATE
Primary = NAME | 'this' | 'super' | NUM | STR | TEMPLATE | REGEX | 'null' | '(paren)' | '[array]' | '{object}' | 'import' '(args)' | 'import' '.' NAME | 'new' '.' NAME | PRIVATE
Primary = 'async'? 'function' '*'? NAME? TP '(params)' TRet '{block}' | Decorator* 'class' NAME? TP Heritage '{class}'
Args = ((Arg ',')* Arg ','?)?
Arg = '...'? Assign
Array = (Arg? ',')* Arg?
For = ('var' | 'let' | 'const') Target T ('of' | 'in') Expr | Lhs ('of' | 'in') Expr | (Var | Expr)? ';' Expr? ';' Expr?
CatchParam = Target T
Params = ((Param ',')* Param ','?)?
Param = Decorator* Access '...'? Target Maybe T Init?
ArrayPattern = (Element? ',')* Element?
Element = '...'? Target Init?
ObjectPattern = ((Field ',')* Field ','?)?
Field = '...' Target | NAME Init? | Key ':' Target Init?
Object = ((Prop ',')* Prop ','?)?
Prop = '...' Assign | Key ':' Assign | NAME Init? | ('async' | 'get' | 'set' | '*')* Key TP '(params)' TRet '{block}'
Key = IDENT | STR | NUM | '[index]'
Members = Member*
Member = ';' | 'static' '{block}' | Decorator* Mod* MemberKey Maybe (TP '(params)' TRet MethodBody | Sure T Init? End)
MethodBody = '{block}'
MemberKey = Key | PRIVATE
Mod = 'static' | 'async' | 'get' | 'set' | '*' | 'accessor'
SwitchItems = (Stmt | Label)*
Label = ('case' Expr | 'default') ':'
Import = 'import' STR With? End | 'import' Clause 'from' STR With? End
Clause = NAME | '{imports}' | All | NAME ',' ('{imports}' | All)
All = '*' 'as' NAME
With = ('with' | 'assert') '{object}'
Imports = ((Spec ',')* Spec ','?)?
Spec = (IDENT | STR) ('as' (IDENT | STR))?
Export = 'export' (Var End | Declared | '{imports}' ('from' STR With?)? End | '*' ('as' (IDENT | STR))? 'from' STR With? End)
Export = 'export' 'default' (!'function' !'class' Assign End | 'async'? 'function' '*'? NAME? TP '(params)' TRet '{block}' | Decorator* 'class' NAME? TP Heritage '{class}' | Declared)
JS: T = 
JS: TRet = 
JS: TP = 
JS: Maybe = 
JS: Sure = 
JS: Access = 
TS: T = (':' Type)?
TS: TRet = (':' Returned)?
TS: Returned = Type | 'asserts'? (NAME | 'this') 'is' Type | 'asserts' (NAME | 'this')
TS: Maybe = '?'?
TS: Sure = '!'?
TS: Access = ('public' | 'private' | 'protected' | 'readonly' | 'override')*
TS: TP = ('<' (TypeParam ',')* TypeParam ','? '>')?
TS: TypeParam = ('const' | 'in' | 'out')* NAME ('extends' Type)? ('=' Type)?
TS: TA = '<' (Type ',')* Type '>'
TS: Type = ('|' | '&')? Single (('|' | '&') Single)* ('extends' Type '?' Type ':' Type)? | ('abstract'? 'new')? TP '(params)' '=>' Returned
TS: Single = ('keyof' | 'unique' | 'readonly' | 'infer')* TypePrimary ('[empty]' | '[type]')*
TS: TypePrimary = NAME ('.' IDENT)* TA? | STR | NUM | '-' NUM | TEMPLATE | 'null' | 'void' | 'this' | '(type)' | '{typeobject}' | '[tuple]' | 'typeof' (NAME | 'import' '(args)') ('.' IDENT)* TA? | 'import' '(args)' ('.' IDENT)* TA?
TS: Tuple = ((TupleItem ',')* TupleItem ','?)?
TS: TupleItem = '...'? Type '?'? | '...'? NAME '?'? ':' Type
TS: Op2 = 'as' Type | 'as' 'const' | 'satisfies' Type
TS: Tail = '!' | TA '(args)' | TA TEMPLATE | '?.' TA '(args)'
TS: Unary = '<' Type '>' Unary
TS: Lhs = 'new' Primary ('.' IDENT)* TA
TS: Heritage = 'extends' Lhs TA? Implements? | Implements
TS: Implements = 'implements' TypeRef (',' TypeRef)*
TS: TypeRef = NAME ('.' IDENT)* TA?
TS: Mod = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
TS: MethodBody = End
TS: Member = Mod* '[signature]' T End
TS: Signature = NAME ':' Type
TS: TypeMembers = (TypeMember (';' | ',' | <nl>))*
TS: TypeMember = ('readonly' | 'get' | 'set' | '+' | '-')* Key '?'? (TP '(params)' TRet | T) | 'new'? TP '(params)' TRet | 'readonly'? ('[signature]' | ('+' | '-')? 'readonly'? '[mapped]' (('+' | '-')? '?')?) T
TS: Mapped = NAME 'in' Type ('as' Type)?
TS: Enum = ((EnumItem ',')* EnumItem ','?)?
TS: EnumItem = (IDENT | STR) Init?
TS: Declared = 'interface' NAME TP ('extends' TypeRef (',' TypeRef)*)? '{iface}' | 'type' NAME TP '=' Type End | 'const'? 'enum' NAME '{enum}' | 'declare' (Declared | Var End | 'global' '{module}') | ('namespace' | 'module') (NAME ('.' NAME)* | STR) '{module}'
TS: Declared = 'abstract' Class | 'async'? 'function' '*'? NAME TP '(params)' TRet End
TS: Import = 'import' 'type' Clause 'from' STR With? End | 'import' 'type'? NAME '=' Assign End
TS: Export = 'export' 'type' ('{imports}' ('from' STR)? | '*' ('as' NAME)? 'from' STR) End | 'export' '=' Assign End | 'export' 'as' 'namespace' NAME End | 'export' Import
TS: Spec = 'type' (IDENT | STR) ('as' (IDENT | STR))?
TS: Params = 'this' ':' Type (',' Param)* ','?
TS: Param = NAME '?' T
"""
SCRIPT_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new null return super switch this throw try typeof var void while with enum await let static yield public private protected implements interface package"
SCRIPT_SLOPPY = "await let static yield public private protected implements interface package"
SCRIPT_CONTEXTUAL = "as async from get of set type namespace module declare abstract readonly override keyof infer is asserts unique satisfies out accessor global assert"
SCRIPT_PUNCTUATION = {
    "ASSIGN": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=",
    "BINOP": "** % == != === !== <= >= << ^ && || ??",
    "PREFIX": "~",
    "": "=> ... ?. ++ -- = * + - / < > | & ? : . , ; @ !",
}
# group kind: (terminal, start symbol), and those that are read piece by piece
SCRIPT_GROUPS = {
    "(": (("(args)", "Args"), ("(params)", "Params"), ("(paren)", "Expr"), ("(for)", "For"), ("(catch)", "CatchParam"), ("(type)", "Type")),
    "[": (("[array]", "Array"), ("[index]", "Expr"), ("[pattern]", "ArrayPattern"), ("[type]", "Type"), ("[tuple]", "Tuple"), ("[signature]", "Signature"), ("[mapped]", "Mapped")),
    "{": (("{object}", "Object"), ("{pattern}", "ObjectPattern"), ("{imports}", "Imports"), ("{typeobject}", "TypeMembers"), ("{enum}", "Enum")),
}
SCRIPT_PIECES = (("{block}", "Stmts"), ("{class}", "Members"), ("{switch}", "SwitchItems"), ("{iface}", "TypeMembers"), ("{module}", "Module"))

# --- Java -----------------------------------------------------------------------------------------------------------
JAVA = """
Unit = UnitItem*
UnitItem = Annotation* 'package' QName ';' | 'import' 'static'? QName ('.' '*')? ';' | 'import' 'module' QName ';' | TypeDecl | ';' | Annotation* 'open'? 'module' QName '{class}'
QName = NAME ('.' NAME)*
TypeDecl = Mod* Declared
Declared = 'class' NAME TP? ('extends' Type)? Implements? Permits? '{class}' | 'interface' NAME TP? ('extends' Types)? Permits? '{class}' | 'enum' NAME Implements? '{enum}' | 'record' NAME TP? '(params)' Implements? '{class}' | '@' 'interface' NAME '{class}'
Implements = 'implements' Types
Permits = 'permits' Types
Types = Type (',' Type)*
Mod = MODIFIER | 'static' | 'final' | 'default' | 'synchronized' | 'sealed' | 'non' '-' 'sealed' | Annotation
Annotation = '@' QName '(annotation)'?
AnnotationArgs = (NAME '=' AnnotationValue (',' NAME '=' AnnotationValue)* | AnnotationValue)?
AnnotationValue = Expr | '{array}' | Annotation
TP = '<' TypeParam (',' TypeParam)* '>'
TypeParam = Annotation* NAME ('extends' Type ('&' Type)*)?
Type = Annotation* (PRIMITIVE | ClassType) (Annotation* '[empty]')*
ClassType = NAME TA? ('.' Annotation* NAME TA?)*
TA = '<' TypeArg (',' TypeArg)* '>'
TypeArg = Type | Annotation* '?' (('extends' | 'super') Type)?
Members = Member*
Member = ';' | 'static'? '{block}' | Mod* Declared | Mod* TP? (Type | 'void') NAME '(params)' Dims Throws? MethodBody | Mod* TP? CLASSNAME '(params)' Throws? '{block}' | Mod* CLASSNAME '{block}' | Mod* Type Declarator (',' Declarator)* ';'
MethodBody = '{block}' | ('default' AnnotationValue)? ';'
Dims = '[empty]'*
Throws = 'throws' Types
Declarator = NAME Dims ('=' Init)?
Init = Expr | '{array}'
ArrayInit = ((Init ',')* Init)? ','?
EnumBody = Constants ';'? | Member*
Constants = ((Constant ',')* Constant)? ','?
Constant = Annotation* NAME '(args)'? '{class}'?
Params = ((Param ',')* Param)?
Param = (Annotation | 'final')* Type ('...' | Annotation)* (NAME | (NAME '.')* 'this') Dims
Stmts = Stmt*
Stmt = '{block}' | ';' | Local ';' | (MODIFIER | 'final' | 'static' | Annotation | 'sealed' | 'non' '-' 'sealed')* Declared | NAME ':' Stmt | StmtExpr ';'
Stmt = 'if' '(expr)' Stmt ('else' Stmt)? | 'while' '(expr)' Stmt | 'do' Stmt 'while' '(expr)' ';' | 'for' '(for)' Stmt | 'switch' '(expr)' '{switch}' | 'synchronized' '(expr)' '{block}'
Stmt = 'try' '(resources)'? '{block}' Handlers | 'return' Expr? ';' | 'throw' Expr ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'assert' Expr (':' Expr)? ';' | 'yield' Expr ';'
Handlers = ('catch' '(catch)' '{block}')* ('finally' '{block}')?
Local = ('final' | Annotation)* Type Declarator (',' Declarator)*
CatchParam = ('final' | Annotation)* Type ('|' Type)* NAME
Resources = Resource (';' Resource)* ';'?
Resource = ('final' | Annotation)* Type NAME '=' Expr | Lhs
For = (Local | StmtExpr (',' StmtExpr)*)? ';' Expr? ';' (StmtExpr (',' StmtExpr)*)? | ('final' | Annotation)* Type NAME ':' Expr
SwitchItems = (Stmt | Label (':' | '->' Arm))*
Label = 'case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default'
CaseItem = Cond | 'default' | Type NAME | RecordPattern
RecordPattern = ClassType '(patterns)' NAME?
Patterns = (PatternItem (',' PatternItem)*)?
PatternItem = Type NAME | RecordPattern
Arm = Expr ';' | '{block}' | 'throw' Expr ';'
StmtExpr = Lhs AssignOp Expr | ('++' | '--') Lhs | Lhs ('++' | '--') | Called
Called = Lhs '(args)' | Creation | Lhs '.' 'new' ClassType Diamond? '(args)' '{class}'?
Creation = 'new' Annotation* ClassType Diamond? '(args)' '{class}'?
Diamond = '<' '>'
Expr = Cond | Lhs AssignOp Expr | Lambda | Cond0 '?' Expr ':' Lambda
Lambda = (NAME | '(params)' | '(names)') '->' (Expr | '{block}')
Names = NAME (',' NAME)*
AssignOp = '=' | ASSIGN | '>~' '>=' | '>~' '>~' '>='
Cond = Cond0 ('?' Expr ':' Expr)?
Cond0 = Unary (Op Unary | 'instanceof' ('final'? Type NAME? | RecordPattern))*
Op = BINOP | '+' | '-' | '*' | '/' | '<' | '&' | '|' | '>~'? '>~'? '>' | '>='
Unary = ('+' | '-' | PREFIX | '++' | '--' | '(cast)')* (Lhs ('++' | '--')? | Switch | '(cast)' Lambda)
Switch = 'switch' '(expr)' '{switch}'
Lhs = Primary Tail*
Tail = '.' TA? (NAME | 'this' | 'super' | 'class') | '.' 'new' ClassType Diamond? '(args)' '{class}'? | '(args)' | '[index]' | '::' TA? (NAME | 'new')
Primary = NAME | 'this' | 'super' | NUM | STR | 'null' | '(expr)' | Creation | 'new' Annotation* (ClassType | PRIMITIVE) ('[index]' '[index]'* '[empty]'* | '[empty]' '[empty]'* '{array}')
Primary = (PRIMITIVE | ClassType) '[empty]'* '::' ('new' | NAME) | (PRIMITIVE | 'void' | ClassType) '[empty]'* '.' 'class'
Args = (Expr (',' Expr)*)?
Cast = Type ('&' Type)*
"""
JAVA_RESERVED = "assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface new null package return static super switch synchronized this throw throws try void while"
JAVA_WORDS = {"MODIFIER": "public private protected abstract native transient volatile strictfp", "PRIMITIVE": "boolean byte short int long char float double"}
JAVA_CONTEXTUAL = "record sealed permits non yield when module open"
JAVA_PUNCTUATION = {
    "ASSIGN": "+= -= *= /= %= <<= &= |= ^=",
    "BINOP": "% == != <= << ^ && ||",
    "PREFIX": "! ~",
    "": "-> :: ... ++ -- = * + - / < > >= | & ? : . , ; @",
}
JAVA_GROUPS = {
    "(": (("(args)", "Args"), ("(params)", "Params"), ("(expr)", "Expr"), ("(for)", "For"), ("(catch)", "CatchParam"), ("(resources)", "Resources"), ("(cast)", "Cast"), ("(names)", "Names"), ("(annotation)", "AnnotationArgs"), ("(patterns)", "Patterns")),
    "[": (("[index]", "Expr"),),
    "{": (("{array}", "ArrayInit"),),
}
JAVA_PIECES = (("{block}", "Stmts"), ("{class}", "Members"), ("{enum}", "EnumBody"), ("{switch}", "SwitchItems"))

# --- SQL: statements end with ';'. Two dialects run together: common SQL, and it with PostgreSQL's additions -------------
SQL = """
Common = (Stmt ';')* Stmt? | ';'*
Stmt = Query | Insert | Update | Delete | Create | Drop | Alter | Grant | Other
Query = With? Body Order? Limits
With = 'WITH' 'RECURSIVE'? Cte (',' Cte)*
Cte = NAME '(names)'? 'AS' ('NOT'? 'MATERIALIZED')? ('(query)' | '(statement)')
Body = Term (('UNION' | 'INTERSECT' | 'EXCEPT' | 'MINUS') ('ALL' | 'DISTINCT')? Term)*
Term = Select | '(query)' | 'VALUES' Rows | 'TABLE' Path
Select = 'SELECT' ('ALL' | 'DISTINCT' ('ON' '(exprs)')? | 'TOP' NUM)? Items ('INTO' Path)? From? ('WHERE' Expr)? ('GROUP' 'BY' ('ALL' | Exprs))? ('HAVING' Expr)? ('WINDOW' NAME 'AS' '(window)' (',' NAME 'AS' '(window)')*)? ('QUALIFY' Expr)?
Items = Item (',' Item)*
Item = Expr ('AS' (NAME | STR) | NAME)? | '*' | Path '.' '*'
From = 'FROM' Table (',' Table)*
Table = Source Join*
Join = ('NATURAL'? ('INNER' | ('LEFT' | 'RIGHT' | 'FULL') 'OUTER'?)? 'JOIN' Source ('ON' Expr | 'USING' '(names)')) | ('CROSS' | 'NATURAL') 'JOIN' Source
Source = 'LATERAL'? ('ONLY'? Path | '(query)' | Call | '(tables)') ('AS'? NAME '(names)'?)? ('TABLESAMPLE' NAME? ('(exprs)' | '(sample)') ('REPEATABLE' '(exprs)')?)?
Sample = Expr ('PERCENT' | 'ROWS')
Order = 'ORDER' 'BY' Key (',' Key)*
Key = Expr ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))?
Limits = Limit*
Limit = 'LIMIT' Expr (',' Expr)? | 'OFFSET' Expr ('ROW' | 'ROWS')? | 'FETCH' ('FIRST' | 'NEXT') Expr? ('ROW' | 'ROWS') ('ONLY' | 'WITH' 'TIES') | 'FOR' ('UPDATE' | 'SHARE') ('OF' Path)? ('NOWAIT' | 'SKIP' 'LOCKED')?
Insert = With? 'INSERT' ('INTO' | 'OVERWRITE' | 'OR' ('REPLACE' | 'IGNORE') 'INTO') 'TABLE'? Path ('AS' NAME)? '(names)'? ('VALUES' Rows | Query | 'DEFAULT' 'VALUES') Conflict? Returning?
Rows = '(row)' (',' '(row)')*
Row = (Expr | 'DEFAULT') (',' (Expr | 'DEFAULT'))*
Conflict = 'ON' 'CONFLICT' ('(exprs)' ('WHERE' Expr)? | 'ON' 'CONSTRAINT' NAME)? 'DO' ('NOTHING' | 'UPDATE' 'SET' Sets ('WHERE' Expr)?) | 'ON' 'DUPLICATE' 'KEY' 'UPDATE' Sets
Returning = 'RETURNING' Items
Sets = Set (',' Set)*
Set = Path '=' (Expr | 'DEFAULT') | '(names)' '=' ('(row)' | '(query)')
Update = With? 'UPDATE' 'ONLY'? Path ('AS'? NAME)? 'SET' Sets From? ('WHERE' Expr)? Returning?
Delete = With? 'DELETE' 'FROM' 'ONLY'? Path ('AS'? NAME)? ('USING' Table (',' Table)*)? ('WHERE' Expr)? Returning?
IfNot = ('IF' 'NOT' 'EXISTS')?
Create = 'CREATE' Temp 'TABLE' IfNot Path ('(columns)' TableOption* ('AS' Query)? | TableOption* 'AS' Query | 'LIKE' Path)
Temp = ('GLOBAL' | 'LOCAL')? ('TEMP' | 'TEMPORARY' | 'UNLOGGED' | 'EXTERNAL')?
TableOption = NAME '='? (NAME | STR | NUM) | 'PARTITION' 'BY' NAME? ('(exprs)' | '(columns)') | 'WITH' '(options)' | 'INHERITS' '(names)' | 'TABLESPACE' NAME | 'USING' NAME | 'COMMENT' '='? STR | 'WITHOUT' 'ROWID'
Columns = ColumnItem (',' ColumnItem)*
ColumnItem = NAME Kind Rule* | Constraint | 'LIKE' Path NAME*
Kind = (NAME | 'DOUBLE' | 'TIMESTAMP' | 'TIME' | 'INTERVAL' | 'CHARACTER' | 'SET') ('PRECISION' | 'VARYING')? '(exprs)'? (('WITH' | 'WITHOUT') 'TIME' 'ZONE')? ('UNSIGNED' | 'SIGNED' | 'ZEROFILL')* '[any]'* | NAME '.' NAME '(exprs)'? '[any]'*
Rule = ('CONSTRAINT' NAME)? ('NOT' 'NULL' | 'NULL' | 'PRIMARY' 'KEY' ('ASC' | 'DESC')? | 'UNIQUE' | 'DEFAULT' Unary | 'CHECK' '(expr)' | References | 'COLLATE' Path | 'GENERATED' ('ALWAYS' | 'BY' 'DEFAULT') 'AS' ('IDENTITY' '(any)'? | '(expr)' ('STORED' | 'VIRTUAL')?) | 'AUTO_INCREMENT' | 'AUTOINCREMENT' | 'COMMENT' STR | 'ON' 'UPDATE' Unary | 'DEFERRABLE' | 'INITIALLY' NAME)
References = 'REFERENCES' Path '(names)'? ('ON' ('DELETE' | 'UPDATE') Action | 'MATCH' NAME | 'NOT'? 'DEFERRABLE' | 'INITIALLY' NAME)*
Action = 'CASCADE' | 'RESTRICT' | 'NO' 'ACTION' | 'SET' ('NULL' | 'DEFAULT')
Constraint = ('CONSTRAINT' NAME)? ('PRIMARY' 'KEY' '(exprs)' | 'UNIQUE' ('KEY' | 'INDEX')? NAME? '(exprs)' | 'CHECK' '(expr)' | 'FOREIGN' 'KEY' NAME? '(names)' References | ('KEY' | 'INDEX') NAME? '(exprs)' | 'EXCLUDE' 'USING' NAME '(any)')
Create = 'CREATE' ('OR' 'REPLACE')? Temp 'RECURSIVE'? 'MATERIALIZED'? 'VIEW' IfNot Path '(names)'? ('WITH' '(options)')? 'AS' Query ('WITH' ('NO' 'DATA' | 'DATA' | NAME* 'CHECK' 'OPTION'))?
Create = 'CREATE' 'UNIQUE'? 'INDEX' 'CONCURRENTLY'? IfNot NAME? 'ON' 'ONLY'? Path ('USING' NAME)? '(keys)' ('INCLUDE' '(names)')? ('WITH' '(options)')? ('TABLESPACE' NAME)? ('WHERE' Expr)?
Create = 'CREATE' ('SCHEMA' | 'DATABASE' | 'EXTENSION' | 'ROLE' | 'USER' | 'SEQUENCE') IfNot Path Loose*
Create = 'CREATE' 'TYPE' Path 'AS' ('ENUM' '(exprs)' | '(columns)') | 'CREATE' 'DOMAIN' Path 'AS'? Kind Rule*
Create = 'CREATE' ('OR' 'REPLACE')? ('FUNCTION' | 'PROCEDURE' | 'TRIGGER') Path Loose* | 'CREATE' 'POLICY' NAME 'ON' Path Loose*
Keys = KeyPart (',' KeyPart)*
KeyPart = Expr NAME? ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))?
Drop = 'DROP' ('TABLE' | 'VIEW' | 'INDEX' | 'SCHEMA' | 'SEQUENCE' | 'TYPE' | 'FUNCTION' | 'PROCEDURE' | 'TRIGGER' | 'DATABASE' | 'MATERIALIZED' 'VIEW' | 'ROLE' | 'USER' | 'EXTENSION' | 'POLICY') 'CONCURRENTLY'? ('IF' 'EXISTS')? Path '(any)'? (',' Path)* ('ON' Path)? ('CASCADE' | 'RESTRICT')?
Alter = 'ALTER' 'TABLE' ('IF' 'EXISTS')? 'ONLY'? Path AlterItem (',' AlterItem)* | 'ALTER' ('VIEW' | 'INDEX' | 'SEQUENCE' | 'SCHEMA' | 'TYPE' | 'ROLE' | 'USER' | 'DATABASE' | 'DEFAULT' | 'FUNCTION') Path? Loose*
AlterItem = 'ADD' ('COLUMN'? IfNot ColumnItem | Constraint) | 'DROP' ('COLUMN' | 'CONSTRAINT' | 'PRIMARY' 'KEY' | 'INDEX')? ('IF' 'EXISTS')? NAME? ('CASCADE' | 'RESTRICT')? | 'ALTER' 'COLUMN'? NAME ('SET' 'DATA'? 'TYPE' Kind ('USING' Expr)? | 'TYPE' Kind ('USING' Expr)? | 'SET' 'DEFAULT' Expr | ('SET' | 'DROP') 'NOT' 'NULL' | 'DROP' 'DEFAULT') | 'RENAME' ('COLUMN' | 'CONSTRAINT')? NAME? 'TO' NAME | 'MODIFY' 'COLUMN'? NAME Kind Rule* | 'OWNER' 'TO' NAME | 'SET' 'SCHEMA' NAME | ('ENABLE' | 'DISABLE') Loose* | 'ATTACH' Loose*
Grant = ('GRANT' | 'REVOKE') Privilege (',' Privilege)* ('ON' ('TABLE' | 'SCHEMA' | 'DATABASE' | 'SEQUENCE' | 'FUNCTION' | 'ALL' NAME 'IN' 'SCHEMA')? Path (',' Path)*)? ('TO' | 'FROM') NAME (',' NAME)* ('WITH' NAME 'OPTION')?
Privilege = 'SELECT' '(names)'? | 'INSERT' | 'UPDATE' '(names)'? | 'DELETE' | 'ALL' NAME? | NAME | 'REFERENCES' | 'TRIGGER' | 'EXECUTE' | 'CREATE'
Other = 'BEGIN' Loose* | ('COMMIT' | 'ROLLBACK' | 'SAVEPOINT' | 'START') Loose* | 'SET' Path ('=' | 'TO') Loose+ | 'SET' NAME Loose* | 'TRUNCATE' 'TABLE'? Path (',' Path)* Loose* | 'COMMENT' 'ON' NAMEISH Path ('(any)')? 'IS' (STR | 'NULL') | 'COMMENT' 'ON' 'TABLE' Path 'IS' (STR | 'NULL') | ('EXPLAIN' | 'ANALYZE') Loose* | 'DO' Loose* | 'CALL' Call | 'USE' NAME | 'MERGE' 'INTO' Path ('AS'? NAME)? 'USING' Source 'ON' Expr Merge+ | ('VACUUM' | 'SHOW' | 'PRAGMA' | 'EXECUTE' | 'COPY' | 'REFRESH') Loose*
Merge = 'WHEN' 'NOT'? 'MATCHED' ('AND' Expr)? 'THEN' ('UPDATE' 'SET' Sets | 'DELETE' | 'INSERT' '(names)'? 'VALUES' '(row)' | 'DO' 'NOTHING')
Loose = WILD
Any = WILD*
Path = NAME ('.' NAME)*
Names = NAME (',' NAME)*
Exprs = Expr (',' Expr)*
Options = Option (',' Option)*
Option = Path ('=' (Unary | NAME | 'ON'))?
Expr = And ('OR' And)*
And = Not ('AND' Not)*
Not = 'NOT'* Compare
Compare = Sum (Comparison)*
Comparison = (CMP | '=' | '<' | '>') (('ANY' | 'ALL' | 'SOME') ('(query)' | '(exprs)') | Sum) | 'IS' 'NOT'? ('NULL' | 'TRUE' | 'FALSE' | 'UNKNOWN' | 'DISTINCT' 'FROM' Sum) | 'NOT'? 'IN' ('(query)' | '(exprs)') | 'NOT'? 'BETWEEN' 'SYMMETRIC'? Sum 'AND' Sum | 'NOT'? ('LIKE' | 'ILIKE' | 'REGEXP' | 'RLIKE' | 'SIMILAR' 'TO') Sum ('ESCAPE' STR)? | 'ISNULL' | 'NOTNULL'
Sum = Unary (('+' | '-' | '*' | '/' | OP) Unary)*
Unary = ('+' | '-' | UNARY)* Primary ('::' Kind | '[any]' | 'COLLATE' Path | 'AT' 'TIME' 'ZONE' Primary)*
Primary = NUM | STR | 'NULL' | 'TRUE' | 'FALSE' | PARAM | Path | '(query)' | '(exprs)' | Call | 'CASE' Expr? When+ ('ELSE' Expr)? 'END' | 'EXISTS' '(query)' | 'CAST' '(cast)' | 'INTERVAL' STR NAME? | ('DATE' | 'TIME' | 'TIMESTAMP') STR | 'ARRAY' ('[any]' | '(query)') | ('CURRENT_DATE' | 'CURRENT_TIMESTAMP' | 'CURRENT_TIME' | 'CURRENT_USER') '(exprs)'? | 'EXTRACT' '(extract)' | 'ROW' '(exprs)'
When = 'WHEN' Expr 'THEN' Expr
Call = (Path | 'LEFT' | 'RIGHT' | 'REPLACE' | 'IF' | 'VALUES' | 'DATE' | 'TIME' | 'TIMESTAMP' | 'SET') ('(call)' | '(empty)') ('FILTER' '(where)')? ('WITHIN' 'GROUP' '(window)')? ('OVER' ('(window)' | '(empty)' | NAME))?
CallArgs = '*' | ('DISTINCT' | 'ALL')? CallArg (',' CallArg)* Order? ('SEPARATOR' STR)? | Expr 'IN' Expr | NAME? Expr? 'FROM' Expr ('FOR' Expr)?
CallArg = Expr ('AS' Kind)? | Expr 'USING' NAME | NAME '=>' Expr
Cast = Expr 'AS' Kind
Extract = NAME 'FROM' Expr
Where = 'WHERE' Expr
Window = NAME? ('PARTITION' 'BY' Exprs)? Order? (('ROWS' | 'RANGE' | 'GROUPS') Frame)?
Frame = Bound | 'BETWEEN' Bound 'AND' Bound
Bound = 'UNBOUNDED' ('PRECEDING' | 'FOLLOWING') | 'CURRENT' 'ROW' | Expr ('PRECEDING' | 'FOLLOWING')
"""
SQL_RESERVED = "SELECT FROM WHERE GROUP ORDER HAVING JOIN ON AND OR NOT INTO VALUES SET CREATE TABLE AS UNION CASE WHEN THEN ELSE END IN IS LIKE BETWEEN LIMIT DISTINCT INNER CROSS NATURAL INTERSECT EXCEPT USING NULL WITH UPDATE DELETE INSERT BY ALL ANY ASC CAST CHECK COLLATE CONSTRAINT DEFAULT DESC FETCH FOR FOREIGN FULL GRANT ILIKE LATERAL OFFSET ONLY PRIMARY REFERENCES RETURNING SIMILAR SOME TO UNIQUE TRUE FALSE"
SQL_GROUPS = {
    "(": (("(query)", "Query"), ("(statement)", "Stmt"), ("(names)", "Names"), ("(exprs)", "Exprs"), ("(expr)", "Expr"), ("(row)", "Row"), ("(columns)", "Columns"), ("(window)", "Window"), ("(options)", "Options"), ("(keys)", "Keys"), ("(call)", "CallArgs"), ("(cast)", "Cast"), ("(extract)", "Extract"), ("(where)", "Where"), ("(tables)", "Table"), ("(sample)", "Sample"), ("(any)", "Any")),
    "[": (("[any]", "Any"),),
    "{": (),
}

# --- Python: brackets are folded first, then each logical line, then each indented suite --------------------------------
PYTHON = """
Line = Simple (';' Simple)* ';'?
If = 'if' Named ':'
Elif = 'elif' Named ':'
ElseLine = 'else' ':'
Try = 'try' ':'
Except = 'except' (Test (',' Test)* ('as' NAME)?)? ':'
ExceptStar = 'except' '*' Test (',' Test)* ('as' NAME)? ':'
FinallyLine = 'finally' ':'
For = 'async'? 'for' Targets 'in' StarExprs ':'
While = 'while' Named ':'
With = 'async'? 'with' (WithItem (',' WithItem)* | '(with)') ':'
WithItem = Test ('as' Target)?
WithItems = WithItem (',' WithItem)* ','?
Def = 'async'? 'def' NAME TypeParams '(params)' ('->' StarExprs)? ':'
Class = 'class' NAME TypeParams '(args)'? ':'
Decorator = '@' Named
Match = 'match' StarExprs ':'
Case = 'case' CasePatterns ('if' Named)? ':'
IfOne = If Line
ElifOne = Elif Line
ElseOne = ElseLine Line
TryOne = Try Line
ExceptOne = Except Line
ExceptStarOne = ExceptStar Line
FinallyOne = FinallyLine Line
ForOne = For Line
WhileOne = While Line
WithOne = With Line
DefOne = Def Line
ClassOne = Class Line
CaseOne = Case Line
TypeParams = '[typeparams]'?
TypeParamList = TypeParam (',' TypeParam)* ','?
TypeParam = NAME (':' Test)? ('=' Test)? | '*' NAME ('=' StarExpr)? | '**' NAME ('=' Test)?
Simple = StarExprs | Assignment | 'pass' | 'break' | 'continue' | 'return' StarExprs? | 'raise' (Test ('from' Test)?)? | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'del' DelTargets | 'assert' Test (',' Test)? | Import | 'type' NAME TypeParams '=' Test | Yield
Assignment = (Targets '=')+ (StarExprs | Yield) | (Single | '(target)') AUG (StarExprs | Yield) | (Single | '(target)') ':' Test ('=' (StarExprs | Yield))?
Import = 'import' Dotted ('as' NAME)? (',' Dotted ('as' NAME)?)* | 'from' (('.' | '...')* Dotted | ('.' | '...')+) 'import' ('*' | '(imports)' | ImportNames)
ImportNames = NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
ImportGroup = ImportNames ','?
Dotted = NAME ('.' NAME)*
DelTargets = DelTarget (',' DelTarget)* ','?
DelTarget = Single | '(del)' | '[del]'
Targets = StarTarget (',' StarTarget)* ','?
StarTarget = '*'? Target
Target = Single | '(targets)' | '[targets]'
Single = NAME | Atom Trailer* Last
Last = '.' NAME | '[index]' | '[array]'
Trailer = '.' NAME | '(args)' | '[index]'
Yield = 'yield' StarExprs? | 'yield' 'from' Test
StarExprs = StarExpr (',' StarExpr)* ','?
StarExpr = '*' Sum | Named
Named = NAME ':=' Test | Test
Test = Or ('if' Or 'else' Test)? | 'lambda' LambdaParams ':' Test
LambdaParams = (LambdaParam (',' LambdaParam)* ','?)?
LambdaParam = NAME ('=' Test)? | '*' NAME? | '**' NAME | '/'
Or = NotTest (('and' | 'or') NotTest)*
NotTest = 'not'* Compare
Compare = Sum ((CMP | 'in' | 'is' | 'not' 'in' | 'is' 'not') Sum)*
Sum = Factor ((OP | '|' | '*' | '**' | '-' | '+' | '/' | '@') Factor)*
Factor = ('+' | '-' | '~')* 'await'? Atom Trailer*
Atom = NAME | NUM | STR STR* | 'None' | '...' | '(paren)' | '(gen)' | '[array]' | '[comp]' | '{dict}' | '{set}'
Paren = StarExprs? | Yield
Field = StarExprs | Yield
Gen = Named CompFor+
CompFor = 'async'? 'for' Targets 'in' Or ('if' OrNamed)*
OrNamed = NAME ':=' Or | Or
Array = StarExprs?
Dict = (Pair (',' Pair)* ','?)? | Pair CompFor+
Pair = Test ':' Test | '**' Sum
Set = StarExprs | Gen
Args = (ArgList ','?)? | Gen
ArgList = Positional (',' Positional)* (',' Keyword)* | Keyword (',' Keyword)*
Positional = Named | '*' Test
Keyword = NAME '=' Test | '*' Test | '**' Test
Index = Slice (',' Slice)* ','?
Slice = Test? ':' Test? (':' Test?)? | StarExpr
Params = (ParamList ','?)?
ParamList = Leading | Leading ',' Starred | Starred
Leading = Plain (',' Plain)* (',' Defaulted)* | Defaulted (',' Defaulted)*
Plain = NAME (':' Test)? | '/'
Defaulted = NAME (':' Test)? '=' Test | '/'
Starred = '*' (NAME (':' StarExpr)?)? (',' NAME (':' Test)? ('=' Test)?)* (',' Gathered)? | Gathered
Gathered = '**' NAME (':' Test)?
TargetGroup = Targets
TargetList = Targets?
DelGroup = DelTargets?
CasePatterns = CasePattern (',' CasePattern)* ','?
CasePattern = '*' NAME | OrPattern ('as' NAME)?
OrPattern = Closed ('|' Closed)*
Closed = '-'? NUM (('+' | '-') NUM)? | STR STR* | 'None' | Dotted | Dotted '(pattern)' | '(pattern)' | '[pattern]' | '{pattern}'
PatternItems = (PatternItem (',' PatternItem)* ','?)?
PatternItem = CasePattern | NAME '=' CasePattern
PatternPairs = (PatternPair (',' PatternPair)* ','?)?
PatternPair = ('-'? NUM (('+' | '-') NUM)? | STR STR* | 'None' | Dotted) ':' CasePattern | '**' NAME
# suites: lines are tokens of their own
Suite = Statement+
File = Statement*
Statement = LINE | ONE | IF SUITE (ELIF SUITE | ELIFONE)* (ELSE SUITE | ELSEONE)? | IFONE (ELIF SUITE | ELIFONE)* (ELSE SUITE | ELSEONE)? | (FOR | WHILE) SUITE (ELSE SUITE | ELSEONE)? | (FORONE | WHILEONE) (ELSE SUITE | ELSEONE)? | WITH SUITE
Statement = (TRY SUITE | TRYONE) ((EXCEPT SUITE | EXCEPTONE)+ (ELSE SUITE | ELSEONE)? (FINALLY SUITE | FINALLYONE)? | (EXCEPTSTAR SUITE | EXCEPTSTARONE)+ (ELSE SUITE | ELSEONE)? (FINALLY SUITE | FINALLYONE)? | FINALLY SUITE | FINALLYONE)
Statement = DECORATOR* (DEF SUITE | CLASS SUITE | DEFONE | CLASSONE) | MATCH CASES
Cases = (CASE SUITE | CASEONE)+
"""
PYTHON_RESERVED = "None and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
PYTHON_CONTEXTUAL = "match case type"
PYTHON_PUNCTUATION = {
    "AUG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=",
    "CMP": "== != <= >= < >",
    "OP": "// % << >> & ^",
    "": ":= -> ... ** * + - / @ ~ = : . , ; |",
}
PYTHON_GROUPS = {
    "(": (("(args)", "Args"), ("(params)", "Params"), ("(paren)", "Paren"), ("(gen)", "Gen"), ("(with)", "WithItems"), ("(target)", "Single"), ("(targets)", "TargetGroup"), ("(imports)", "ImportGroup"), ("(del)", "DelGroup"), ("(pattern)", "PatternItems")),
    "[": (("[array]", "Array"), ("[comp]", "Gen"), ("[index]", "Index"), ("[targets]", "TargetList"), ("[del]", "DelGroup"), ("[pattern]", "PatternItems"), ("[typeparams]", "TypeParamList")),
    "{": (("{dict}", "Dict"), ("{set}", "Set"), ("{pattern}", "PatternPairs")),
}
PYTHON_LINES = {
    "LINE": "Line", "IF": "If", "ELIF": "Elif", "ELSE": "ElseLine", "TRY": "Try", "EXCEPT": "Except", "EXCEPTSTAR": "ExceptStar", "FINALLY": "FinallyLine", "FOR": "For", "WHILE": "While", "WITH": "With",
    "DEF": "Def", "CLASS": "Class", "DECORATOR": "Decorator", "MATCH": "Match", "CASE": "Case", "IFONE": "IfOne", "ELIFONE": "ElifOne", "ELSEONE": "ElseOne", "TRYONE": "TryOne", "EXCEPTONE": "ExceptOne", "EXCEPTSTARONE": "ExceptStarOne", "FINALLYONE": "FinallyOne",
    "FORONE": "ForOne", "WHILEONE": "WhileOne", "ONE": "WithOne", "DEFONE": "DefOne", "CLASSONE": "ClassOne", "CASEONE": "CaseOne",
}

# --- settings files -------------------------------------------------------------------------------------------------
JSON = """
Value = STR | NUM | WORD | '{object}' | '[array]'
Object = (Pair (',' Pair)*)?
Pair = STR ':' Value
Array = (Value (',' Value)*)?
"""
JSON_GROUPS = {"(": (), "[": (("[array]", "Array"),), "{": (("{object}", "Object"),)}

TOML = """
Line = Key '=' Value | '[header]' | '[[header]]'
Key = Part ('.' Part)*
Part = BARE | STR
Header = Key
Value = STR | SCALAR | BARE | '[array]' | '{table}'
Array = ((Value ',')* Value ','?)?
Table = ((Entry ',')* Entry)?
Entry = Key '=' Value
"""
TOML_GROUPS = {"(": (), "[": (("[array]", "Array"), ("[header]", "Header")), "{": (("{table}", "Table"),)}

INI = """
Line = SECTION | KEY EQUALS VALUE?
"""

# lines of a YAML block are tokens; deeper lines fold to one of NESTED before the lines around them are read
YAML = """
Document = Node?
Node = Map | Seq | SCALAR | FLOW
Map = MapItem+
MapItem = KEYVALUE | KEYONLY (NESTED | SEQSAME)? | KEYPROPS (NESTED | SEQSAME)? | KEYBLOCK BLOCKTEXT? | MERGE
Seq = SeqItem+
SeqItem = DASHSCALAR | DASHONLY NESTED? | DASHMAP NESTED? | DASHBLOCK BLOCKTEXT?
FlowMap = ((FlowPair ',')* FlowPair ','?)?
FlowPair = FlowValue (':' FlowValue?)?
FlowSeq = ((FlowItem ',')* FlowItem ','?)?
FlowItem = FlowValue (':' FlowValue?)?
FlowValue = PLAIN | STR | '[seq]' | '{map}' | ANCHOR+ (PLAIN | STR | '[seq]' | '{map}')? | ALIAS
"""
YAML_GROUPS = {"(": (), "[": (("[seq]", "FlowSeq"),), "{": (("{map}", "FlowMap"),)}
