"""Grammars of problem 7 in extended BNF, one per language, and their lexical classes.

Terminals in upper case are classes of the lexer: NAME, NUM, STR, NL, IN and DE (line end, indent,
dedent), END, ASI (an inserted semicolon), UN and BIN (prefix and infix operators that need no rule of
their own), ASG (assignment operators), REGEX and TEMPLATE. A template or f-string with code in it comes in
parts: THEAD TMID TTAIL, FHEAD FMID FTAIL, and within a field's format FSPEC, FO and FC.
"""

from __future__ import annotations

PYTHON = """
file: stmts END | END
stmts: stmt+
stmt: line | compound
line: small (';' small)* ';'? NL
small: exprs | tlist '=' sources | tprim ':' test ('=' source)? | '(' name ')' ':' test ('=' source)? | aug ASG source | yields | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (test ('from' test)?)? | 'global' names | 'nonlocal' names | 'del' tlist | 'assert' test (',' test)? | 'type' name tparams? '=' test | import
aug: name | primary '.' name | primary '[' subs ']' | '(' aug ')'
sources: source | tlist '=' sources
source: exprs | yields
yields: 'yield' exprs? | 'yield' 'from' test
names: name (',' name)*
import: 'import' dotas (',' dotas)* | 'from' origin 'import' '*' | 'from' origin 'import' nameas (',' nameas)* | 'from' origin 'import' '(' nameas (',' nameas)* ','? ')'
dotas: dotted ('as' name)?
nameas: name ('as' name)?
dotted: name ('.' name)*
origin: dotted | dots dotted?
dots: ('.' | '...')+
name: NAME | 'match' | 'case' | 'type'
exprs: eitem (',' eitem)* ','?
eitem: test | '*' bin
tlist: titem (',' titem)* ','?
titem: '*'? tprim
tprim: name | primary '.' name | primary '[' subs ']' | '(' tlist? ')' | '[' tlist? ']'
compound: 'if' named ':' suite elif* else? | 'while' named ':' suite else? | 'async'? 'for' tlist 'in' exprs ':' suite else? | try | 'async'? 'with' withs ':' suite | def | class | decorator+ def | decorator+ class | 'match' exprs ':' NL IN case+ DE
elif: 'elif' named ':' suite
else: 'else' ':' suite
finally: 'finally' ':' suite
try: 'try' ':' suite except+ else? finally? | 'try' ':' suite finally
except: 'except' ':' suite | 'except' '*'? test (',' test)* ('as' name)? ':' suite
withs: with (',' with)* | '(' with (',' with)* ','? ')'
with: test ('as' tprim)?
decorator: '@' named NL
def: 'async'? 'def' name tparams? '(' params? ')' ('->' test)? ':' suite
class: 'class' name tparams? ('(' args? ')')? ':' suite
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: name (':' test)? ('=' test)? | '*' name | '**' name
suite: line | NL IN stmts DE
case: 'case' patterns ('if' named)? ':' suite
patterns: pattern (',' pattern)* ','?
pattern: bin ('as' name)? | '*' name
params: plains (',' defaults)? (',' stars)? ','? | defaults (',' stars)? ','? | stars ','?
plains: plain (',' (plain | '/'))*
defaults: default (',' (default | '/'))*
plain: name (':' test)?
default: name (':' test)? '=' test
stars: '*' name (':' eitem)? (',' kw)* (',' kwargs)? | '*' (',' kw)+ (',' kwargs)? | kwargs
kw: plain | default
kwargs: '**' name (':' test)?
lparams: lplains (',' ldefaults)? (',' lstars)? ','? | ldefaults (',' lstars)? ','? | lstars ','?
lplains: name (',' (name | '/'))*
ldefaults: ldefault (',' (ldefault | '/'))*
ldefault: name '=' test
lstars: '*' name (',' lkw)* (',' '**' name)? | '*' (',' lkw)+ (',' '**' name)? | '**' name
lkw: name | ldefault
named: test | name ':=' test
test: or | or 'if' or 'else' test | 'lambda' lparams? ':' test
or: not (('and' | 'or') not)*
not: 'not' not | compare
compare: bin (compares bin)*
compares: CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not'
bin: unary (bins unary)*
bins: BIN | '+' | '-' | '*' | '**' | '/' | '@'
unary: ('+' | '-' | UN) unary | 'await'? primary
primary: atom | primary '.' name | primary '(' args? ')' | primary '[' subs ']'
atom: name | NUM | string+ | '...' | CONST | '(' ')' | '(' yields ')' | '(' items ')' | '[' ']' | '[' items ']' | '{' '}' | '{' items '}' | '{' dicts '}'
string: STR | FHEAD field (FMID field)* FTAIL
field: shown (FSPEC inner*)?
inner: FO field FC
shown: source '='? ('!' NAME)?
items: item (',' item)* ','? | item comps
item: named | '*' bin
comps: comp+
comp: 'async'? 'for' tlist 'in' or | 'if' or | 'if' name ':=' or | 'if' 'lambda' lparams? ':' test
dicts: dict (',' dict)* ','? | test ':' test comps
dict: test ':' test | '**' bin
args: pargs (',' kargs)? (',' dargs)? ','? | kargs (',' dargs)? ','? | dargs ','? | named comps
pargs: parg (',' parg)*
parg: named | '*' test
kargs: karg (',' (karg | '*' test))*
karg: name '=' test
dargs: '**' test (',' ('**' test | karg))*
subs: sub (',' sub)* ','?
sub: named | '*' bin | test? ':' test? | test? ':' test? ':' test?
"""

# One text for JavaScript modules and TypeScript: lines that begin with ts| belong to the latter only.
# Rules named with @ exist twice: plain, and with S for expressions that may begin a statement.
_SCRIPT = """
file: stmts END | END
stmts: item+
item: stmt | import | export
semi: ';' | ASI
stmt: block | ';' | decl | exprS semi | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | loop | 'continue' ident? semi | 'break' ident? semi | 'return' expr? semi | 'throw' expr semi | 'switch' '(' expr ')' '{' case* '}' | try | ident ':' stmt | 'debugger' semi
block: '{' stmts? '}'
decl: vars semi | func | class
ts|decl: 'interface' ident tparams? ('extends' types)? members | 'type' ident tparams? '=' type semi | 'const'? 'enum' ident '{' enums? '}' | ('namespace' | 'module') entity block | 'module' STR block? | 'declare' decl | 'declare' 'global' block | 'abstract' class | 'import' ident '=' expr semi | 'declare' 'module' STR semi
ts|enums: enum (',' enum)* ','?
ts|enum: prop ('=' assign)?
vars: ('var' | 'let' | 'const' | 'using') binds
binds: bind (',' bind)*
bind: target ('=' assign)?
ts|bind: target '!'? annot ('=' assign)?
loop: 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' semi | 'do' stmt 'while' '(' expr ')' | 'for' 'await'? '(' head ')' stmt
head: forinit? ';' expr? ';' expr? | forleft 'of' assign | forleft 'in' expr
forinit: vars | expr
forleft: ('var' | 'let' | 'const') target | lhs
case: 'case' expr ':' stmts? | 'default' ':' stmts?
try: 'try' block 'catch' ('(' target ')')? block | 'try' block 'catch' ('(' target ')')? block 'finally' block | 'try' block 'finally' block
ts|try: 'try' block 'catch' '(' target annot ')' block | 'try' block 'catch' '(' target annot ')' block 'finally' block
import: 'import' STR with? semi | 'import' imports 'from' STR with? semi
ts|import: 'import' 'type' imports 'from' STR with? semi
with: ('with' | 'assert') object
imports: ident | '*' 'as' ident | namelist | ident ',' '*' 'as' ident | ident ',' namelist
namelist: '{' '}' | '{' spec (',' spec)* ','? '}'
spec: prop | prop 'as' prop
ts|spec: 'type' prop | 'type' prop 'as' prop
export: 'export' decl | 'export' 'default' func | 'export' 'default' class | 'export' 'default' assignS semi | 'export' namelist semi | 'export' namelist 'from' STR with? semi | 'export' '*' ('as' prop)? 'from' STR with? semi | decorator+ 'export' 'default'? class
ts|export: 'export' 'type' namelist ('from' STR)? semi | 'export' '=' expr semi | 'export' 'default' 'abstract' class | 'export' 'default' 'interface' ident tparams? ('extends' types)? members | 'export' 'as' 'namespace' ident semi
ident: NAME | 'of' | 'as' | 'from' | 'get' | 'set' | 'async' | 'using' | 'assert'
ts|ident: 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'global' | 'abstract' | 'readonly' | 'keyof' | 'infer' | 'is' | 'satisfies' | 'public' | 'private' | 'protected' | 'override' | 'asserts' | 'unique' | 'accessor' | 'out'
word: 'var' | 'let' | 'static' | 'const' | 'if' | 'else' | 'for' | 'while' | 'do' | 'continue' | 'break' | 'return' | 'throw' | 'switch' | 'case' | 'default' | 'try' | 'catch' | 'finally' | 'function' | 'class' | 'extends' | 'new' | 'this' | 'super' | 'import' | 'export' | 'in' | 'instanceof' | 'debugger' | 'with' | 'yield' | 'await' | 'enum' | UNW | CONST
prop: ident | word
key: prop | STR | NUM | '[' assign ']' | PRIV
func: 'async'? 'function' '*'? ident? sig block
ts|func: 'async'? 'function' ident? sig semi
sig: '(' params? ')'
ts|sig: tparams? '(' params? ')' returns?
params: param (',' param)* ','?
param: decorator* target ('=' assign)? | decorator* '...' target
ts|param: decorator* access+ target '?'? annot? ('=' assign)? | decorator* target '?'? annot ('=' assign)? | decorator* target '?' | decorator* '...' target annot | 'this' annot
ts|access: 'public' | 'private' | 'protected' | 'readonly' | 'override'
target: ident | '[' elements? ']' | '{' '}' | '{' props ','? '}'
elements: ','* element (','+ element)* ','* | ','+
element: target ('=' assign)? | '...' target
props: propt (',' propt)*
propt: ident ('=' assign)? | key ':' target ('=' assign)? | '...' ident
class: decorator* 'class' ident? ('extends' lhs)? body
ts|class: decorator* 'class' ident? tparams? ('extends' lhs targs?)? ('implements' types)? body
body: '{' member* '}'
member: ';' | decorator* mods key sig block | decorator* mods ('get' | 'set') key sig block | decorator* mods 'async'? '*' key sig block | decorator* mods 'async' key sig block | decorator* mods key ('=' assign)? semi | 'static' block | decorator* key sig block | decorator* ('get' | 'set') key sig block | decorator* 'async'? '*' key sig block | decorator* 'async' key sig block | decorator* key ('=' assign)? semi
ts|member: decorator* mods? key '?'? sig semi | decorator* mods? key ('?' | '!')? annot ('=' assign)? semi | decorator* mods? key '?' ('=' assign)? semi | mods? '[' ident ':' type ']' annot semi | decorator* mods? ('get' | 'set') key sig semi | decorator* mods? 'async' key sig semi | decorator* mods? key '?' sig block
mods: 'static'
ts|mods: mod+
ts|mod: 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor'
decorator: '@' deco
deco: ident | deco '.' prop | deco args | '(' expr ')'
expr@: assign@ | expr@ ',' assign
assign@: cond@ | lhs@ asg assign | arrow | 'yield' '*'? assign | 'yield'
asg: '=' | ASG | '>' GE | '>' '>' GE
arrow: ident '=>' fbody | 'async' ident '=>' fbody | 'async'? sig '=>' fbody
fbody: block | assignN
cond@: bin@ | bin@ '?' assign ':' assign
bin@: unary@ | bin@ binop unary
ts|bin@: bin@ ('as' | 'satisfies') type | bin@ 'as' 'const'
binop: BIN | '<' | '>' | '>' '>' | '>' '>' '>' | GE | '*' | '+' | '-' | 'in' | 'instanceof' | '|' | '&'
unary@: post@ | (UN | UNW | '+' | '-' | '!' | INC | 'await') unary
ts|unary@: '<' type '>' unary | '<' 'const' '>' unary
post@: lhs@ | lhs@ INC
lhs@: primary@ | lhs@ '.' prop | lhs@ '.' PRIV | lhs@ '?.' (prop | PRIV | args | '[' expr ']') | lhs@ '[' expr ']' | lhs@ args | lhs@ template | 'new' callee args? | 'super' args | 'super' '.' prop | 'super' '[' expr ']' | 'import' args | 'import' '.' prop
ts|lhs@: lhs@ '!' | lhs@ targs args | lhs@ targs template | lhs@ targs | lhs@ '?.' targs args | 'new' callee targs args
callee: primary | callee '.' prop | callee '[' expr ']' | 'new' '.' prop | callee '.' PRIV
primary@: simple
simple: ident | NUM | STR | CONST | REGEX | template | 'this' | '(' expr ')' | '[' items? ']' | 'new' '.' prop | PRIV
primary: func | class | object
primaryN: func | class
template: TEMPLATE | THEAD expr (TMID expr)* TTAIL
items: ','* spread (','+ spread)* ','* | ','+
spread: assign | '...' assign
args: '(' ')' | '(' spread (',' spread)* ','? ')'
object: '{' '}' | '{' entry (',' entry)* ','? '}'
entry: ident ('=' assign)? | key ':' assign | '...' assign | 'async'? '*'? key sig block | ('get' | 'set') key sig block
ts|annot: ':' type
ts|returns: ':' type | ':' 'asserts'? (ident | 'this') 'is' type | ':' 'asserts' (ident | 'this')
ts|tparams: '<' tparam (',' tparam)* ','? '>'
ts|tparam: ('const' | 'in' | 'out')? ident ('extends' type)? ('=' type)?
ts|targs: '<' type (',' type)* '>'
ts|types: tref (',' tref)*
ts|tref: lhs targs? | lhs
ts|type: union | union 'extends' union '?' type ':' type | tparams? '(' params? ')' '=>' rtype | 'abstract'? 'new' tparams? '(' params? ')' '=>' type
ts|rtype: type | 'asserts'? (ident | 'this') 'is' type
ts|union: '|'? inter ('|' inter)*
ts|inter: '&'? tpre ('&' tpre)*
ts|tpre: tpost | ('keyof' | 'unique' | 'readonly' | 'infer') tpre | 'infer' ident 'extends' tpost
ts|tpost: tprim | tpost '[' ']' | tpost '[' type ']'
ts|tprim: '(' type ')' | entity targs? | STR | NUM | '-' NUM | TEMPLATE | THEAD type (TMID type)* TTAIL | CONST | 'this' | UNW | UNW entity targs? | UNW 'import' '(' STR ')' | 'import' '(' STR ')' ('.' entity)? targs? | members | mapped | '[' ']' | '[' telem (',' telem)* ','? ']'
ts|telem: type | '...' type | ident '?'? ':' type | '...' ident ':' type | type '?'
ts|entity: ident ('.' prop)*
ts|members: '{' '}' | '{' tmember (tsep tmember)* tsep? '}'
ts|tsep: ';' | ',' | ASI
ts|tmember: key '?'? annot? | key '?'? sig | sig | 'new' sig | 'readonly' key '?'? annot? | ('get' | 'set') key sig | 'readonly'? '[' ident ':' type ']' annot
ts|mapped: '{' ('+' | '-')? 'readonly'? '[' ident 'in' type ('as' type)? ']' (('+' | '-')? '?')? annot? ';'? '}'
"""

GO = """
file: 'package' NAME ';' imports? decls? END
imports: (import ';')+
import: 'import' spec | 'import' '(' ')' | 'import' '(' spec (';' spec)* ';'? ')'
spec: STR | '.' STR | NAME STR
decls: (decl ';')+
decl: gen | 'func' NAME tparams? sig block? | 'func' params NAME sig block?
gen: ('const' | 'var') value | ('const' | 'var') '(' ')' | ('const' | 'var') '(' value (';' value)* ';'? ')' | 'type' tspec | 'type' '(' ')' | 'type' '(' tspec (';' tspec)* ';'? ')'
value: names type? '=' exprs | names type | names
names: NAME (',' NAME)*
tspec: NAME tparams? '='? type
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: names constraint
constraint: cterm ('|' cterm)*
cterm: '~'? type
sig: params result?
result: params | type
params: '(' ')' | '(' param (',' param)* ','? ')'
param: type | NAME type | NAME? '...' type
type: tname | '*' type | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | 'func' sig | 'struct' '{' '}' | 'struct' '{' field (';' field)* ';'? '}' | 'interface' '{' '}' | 'interface' '{' method (';' method)* ';'? '}' | '(' type ')'
tname: NAME | NAME '.' NAME | NAME targs | NAME '.' NAME targs
targs: '[' type (',' type)* ','? ']'
field: names type STR? | '*'? tname STR?
method: NAME sig | constraint
block: '{' '}' | '{' stmts '}' | '{' ';' '}'
stmts: stmt (semis stmt)* semis? | semis stmts
semis: ';'+
stmt: simple | gen | block | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | 'go' expr | 'defer' expr | if | NAME ':' stmt | NAME ':' | 'for' block | 'for' forhead block | 'switch' swhead? '{' scase* '}' | 'select' '{' ccase* '}'
simple: expr | expr INC | expr '<-' expr | exprs ('=' | ASG | ':=') exprs
if: 'if' (simple? ';')? simple block | 'if' (simple? ';')? simple block 'else' if | 'if' (simple? ';')? simple block 'else' block
forhead: simple | simple? ';' simple? ';' simple? | exprs ('=' | ':=') 'range' expr | 'range' expr
swhead: simple | simple? ';' simple?
scase: 'case' exprt (',' exprt)* ':' stmts? | 'default' ':' stmts?
exprt: expr | type
ccase: 'case' simple ':' stmts? | 'default' ':' stmts?
exprs: expr (',' expr)*
expr: unary (binop unary)*
binop: BIN | '*' | '+' | '-' | '|' | '&' | '^'
unary: primary | ('+' | '-' | '!' | '^' | '&' | '*' | '<-' | '~') unary
primary: NAME | NUM | STR | '(' expr ')' | 'func' sig block | lit | primary '.' NAME | primary '.' '(' type ')' | primary '.' '(' 'type' ')' | primary '[' expr ']' | primary '[' expr? ':' expr? ']' | primary '[' expr? ':' expr ':' expr ']' | primary '[' exprt (',' exprt)+ ','? ']' | primary '[' type ']' | primary '(' ')' | primary '(' cargs '...'? ','? ')' | conv '(' expr ','? ')'
conv: '[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' type | 'interface' '{' '}' | 'func' sig | '(' type ')' | 'struct' '{' '}'
cargs: exprt (',' exprt)*
lit: littype braces
littype: tname | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'struct' '{' '}' | 'struct' '{' field (';' field)* ';'? '}'
braces: '{' '}' | '{' elem (',' elem)* ','? '}'
elem: evalue | evalue ':' evalue
evalue: expr | braces
"""

JAVA = """
file: package? import* decl+ END | package import* END | import+ END | END
package: annot* 'package' qname ';'
import: 'import' 'static'? qname ('.' '*')? ';' | ';'
qname: ident ('.' ident)*
ident: NAME | 'record' | 'sealed' | 'permits' | 'yield' | 'var' | 'when' | 'module' | 'open' | 'with' | 'to'
annot: '@' qname | '@' qname '(' ')' | '@' qname '(' avalue ')' | '@' qname '(' pair (',' pair)* ')'
pair: ident '=' avalue
avalue: cond | annot | '{' '}' | '{' avalue (',' avalue)* ','? '}'
mod: annot | MOD | 'static' | 'default' | 'sealed' | 'final' | 'synchronized' | 'abstract'
decl: mod* 'class' ident tparams? ('extends' type)? ('implements' types)? ('permits' types)? body | mod* 'interface' ident tparams? ('extends' types)? ('permits' types)? body | mod* 'enum' ident ('implements' types)? '{' consts? (';' member*)? '}' | mod* 'record' ident tparams? '(' params? ')' ('implements' types)? body | mod* '@' 'interface' ident body | ';'
consts: const (',' const)* ','?
const: annot* ident args? body?
body: '{' member* '}'
member: decl | mod* vars ';' | mod* tparams? rtype ident '(' params? ')' dims? throws? mbody | mod* tparams? ident '(' params? ')' throws? block | 'static'? block | mod* rtype ident '(' ')' 'default' avalue ';' | mod* ident block
mbody: block | ';'
throws: 'throws' types
vars: type declr (',' declr)*
declr: ident dims? ('=' init)?
dims: (annot* '[' ']')+
init: expr | '{' '}' | '{' init (',' init)* ','? '}'
rtype: type | 'void'
params: param (',' param)* ','?
param: mod* type (annot* '...')? ident dims? | mod* type (ident '.')? 'this'
type: annot* base dims?
base: PRIM | cname
cname: ident targs? | cname '.' annot* ident targs?
types: type (',' type)*
targs: '<' '>' | '<' targ (',' targ)* '>'
targ: type | annot* '?' | annot* '?' ('extends' | 'super') type
tparams: '<' tparam (',' tparam)* '>'
tparam: annot* ident ('extends' type ('&' type)*)?
block: '{' stmt* '}'
stmt: block | ';' | decl | mod* vars ';' | effect ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' finit? ';' expr? ';' effects? ')' stmt | 'for' '(' mod* type ident ':' expr ')' stmt | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | switch | try | ident ':' stmt | ctor ';'
ctor: ('this' | 'super') args | primary '.' 'super' args
finit: mod* vars | effects
effects: effect (',' effect)*
effect: assign | INC unary | postfix INC | call | new | switch
assign: postfix asg expr
asg: '=' | ASG | '>' GE | '>' '>' GE
switch: 'switch' '(' expr ')' '{' group* '}'
group: label ':' stmt* | label '->' arm
label: 'case' labels ('when' expr)? | 'default'
labels: lab (',' lab)*
lab: cond | pattern | 'default'
pattern: mod* type ident | type '(' ')' | type '(' pattern (',' pattern)* ')' ident?
arm: expr ';' | block | 'throw' expr ';'
try: 'try' resources? block catch* | 'try' resources? block catch* 'finally' block
resources: '(' resource (';' resource)* ';'? ')'
resource: mod* type ident '=' expr | postfix
catch: 'catch' '(' mod* type ('|' type)* ident ')' block
expr: cond | assign | lambda
lambda: ident '->' lbody | '(' ')' '->' lbody | '(' ident (',' ident)* ')' '->' lbody | '(' params ')' '->' lbody
lbody: expr | block
cond: bin | bin '?' expr ':' cond | bin '?' expr ':' lambda
bin: unary | bin binop unary | bin 'instanceof' 'final'? type ident? | bin 'instanceof' pattern
binop: BIN | '<' | '>' | '>' '>' | '>' '>' '>' | GE | '*' | '+' | '-' | '|' | '&'
unary: postfix | postfix INC | ('+' | '-' | UN | INC) unary | '(' type ('&' type)* ')' unary | '(' type ('&' type)* ')' lambda | switch
postfix: primary
primary: ident | NUM | STR | CONST | 'this' | '(' expr ')' | new | call | primary '.' ident | primary '.' 'this' | primary '.' new | 'super' '.' ident | primary '[' expr ']' | base dims? '.' 'class' | 'void' '.' 'class' | primary '::' targs? (ident | 'new') | base dims? '::' targs? (ident | 'new') | 'super' '::' ident | primary '.' 'super' '::' ident | primary '.' 'super' '.' ident
call: ident args | primary '.' targs? ident args | 'super' '.' targs? ident args | primary '.' 'super' '.' ident args
new: 'new' annot* (PRIM | cname) args body? | 'new' annot* (PRIM | cname) dim+ dims? | 'new' annot* (PRIM | cname) dims '{' '}' | 'new' annot* (PRIM | cname) dims '{' init (',' init)* ','? '}'
dim: '[' expr ']'
args: '(' ')' | '(' expr (',' expr)* ')'
"""


def script(typed: bool) -> str:
    """The grammar of JavaScript modules, or of TypeScript."""
    rules: list[str] = []
    for rule in _SCRIPT.strip().split("\n"):
        if rule.startswith("ts|"):
            if not typed:
                continue
            rule = rule[3:]
        if "@" in rule.split(":")[0]:
            for suffix in ("", "S", "N"):
                rules.append(rule.replace("'@'", "\0").replace("@", suffix).replace("\0", "'@'"))
        else:
            rules.append(rule)
    return "\n".join(rules)
