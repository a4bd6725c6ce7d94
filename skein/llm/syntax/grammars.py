"""Grammars of the bundled languages, written for recognition.

Binary operators are one flat level, since precedence cannot make a text
invalid; where a language is ambiguous, both readings run side by side.
"""

from __future__ import annotations

PYTHON = r"""
file : stmt*
stmt : simples | compound
simples : simple %% ';' NEWLINE
block : NEWLINE INDENT stmt+ DEDENT | simples
simple : exprs | assignment | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'pass' | 'break' | 'continue'
  | 'del' target %% ',' | 'assert' expr (',' expr)? | 'global' name % ',' | 'nonlocal' name % ','
  | 'import' (dotted ('as' name)?) % ',' | 'from' source 'import' names | 'type' name tparams? '=' expr | yield
source : dotted | dots dotted?
dots : ('.' | '...')+
dotted : name % '.'
names : '*' | imported % ',' | '(' imported %% ',' ')'
imported : name ('as' name)?
assignment : place ':' expr ('=' value)? | '(' place ')' ':' expr ('=' value)? | (targets '=')+ value | place augop value
value : exprs | yield
augop : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
place : name | primary '.' name | primary '[' slices ']'
targets : startarget %% ','
startarget : '*'? target
target : place | '(' targets? ')' | '[' targets? ']'
yield : 'yield' exprs? | 'yield' 'from' expr
exprs : starexpr %% ','
starexpr : '*' binary | expr
named : name ':=' expr | expr
starnamed : '*' binary | named
expr : binary | binary 'if' binary 'else' expr | lambda
lambda : 'lambda' lparams? ':' expr
lparams : lparam %% ','
lparam : name ('=' expr)? | '*' name? | '/' | '**' name
binary : unary | binary binop unary
binop : 'or' | 'and' | '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
unary : ('not' | '-' | '+' | '~') unary | 'await'? primary
primary : atom | primary '.' name | primary '(' args? ')' | primary '[' slices ']'
atom : name | NUMBER | strings | BYTES+ | '...' | 'None' | 'True' | 'False'
  | '(' (starnamed %% ',')? ')' | '(' yield ')' | '(' named comp ')' | '[' (starnamed %% ',')? ']' | '[' named comp ']'
  | '{' (dictitem %% ',')? '}' | '{' expr ':' expr comp '}' | '{' starnamed %% ',' '}' | '{' named comp '}'
strings : (STRING | fstring)+
fstring : FSTART field* FEND
field : '{' value '='? ('!' name)? (FSPEC field*)? '}'
dictitem : expr ':' expr | '**' binary
comp : ('async'? 'for' targets 'in' binary ('if' cond)*)+
cond : binary | lambda | name ':=' binary
slices : slice %% ','
slice : starnamed | expr? ':' expr? (':' expr?)?
args : posarg %% ',' | posarg % ',' ',' keywords | keywords | named comp
posarg : named | '*' expr
keywords : keytail | keystar % ',' ',' keytail | keystar %% ','
keytail : keydouble %% ','
keystar : name '=' expr | '*' expr
keydouble : name '=' expr | '**' expr
compound : decorator* 'async'? 'def' name tparams? '(' (param %% ',')? ')' ('->' expr)? ':' block
  | decorator* 'class' name tparams? ('(' args? ')')? ':' block
  | 'if' named ':' block elif* else? | 'while' named ':' block else?
  | 'async'? 'for' targets 'in' exprs ':' block else?
  | 'try' ':' block (except+ else? finally? | finally)
  | 'async'? 'with' withitem % ',' ':' block | 'async'? 'with' '(' withitem %% ',' ')' ':' block
  | 'match' subject ':' NEWLINE INDENT case+ DEDENT
decorator : '@' named NEWLINE
tparams : '[' tparam %% ',' ']'
tparam : name (':' expr)? ('=' expr)? | '*' name ('=' starexpr)? | '**' name ('=' expr)?
param : name (':' expr)? ('=' expr)? | '*' | '*' name (':' starexpr)? | '/' | '**' name (':' expr)?
elif : 'elif' named ':' block
else : 'else' ':' block
except : 'except' (expr ('as' name)?)? ':' block | 'except' '*' expr ('as' name)? ':' block
finally : 'finally' ':' block
withitem : expr ('as' target)?
subject : named | starnamed ',' | starnamed ',' (starnamed %% ',')
case : 'case' patterns ('if' named)? ':' block
patterns : pattern | starpattern ',' | starpattern ',' (starpattern %% ',')
starpattern : '*' name | pattern
pattern : orpattern ('as' name)?
orpattern : closed % '|'
closed : '-'? NUMBER (('+' | '-') NUMBER)? | strings | BYTES+ | 'None' | 'True' | 'False' | dotted | '(' (starpattern %% ',')? ')' | '[' (starpattern %% ',')? ']'
  | '{' (mapitem %% ',')? '}' | dotted '(' (classarg %% ',')? ')'
mapitem : (closed | dotted) ':' pattern | '**' name
classarg : pattern | name '=' pattern
name : NAME | 'match' | 'case' | 'type'
"""

JAVA = r"""
unit : package? import* type* | modular
package : annotation* 'package' qname ';'
import : 'import' 'static'? qname ('.' '*')? ';' | ';'
qname : ident % '.'
modular : import* annotation* 'open'? 'module' qname '{' directive* '}'
directive : 'requires' ('transitive' | 'static')* qname ';' | ('exports' | 'opens') qname ('to' qname % ',')? ';' | 'uses' qname ';' | 'provides' qname 'with' qname % ',' ';'
type : modifier* typedecl | ';'
typedecl : class | enum | record | interface | atype
modifier : annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
annotation : '@' qname ('(' (apair %% ',' | avalue)? ')')?
apair : ident '=' avalue
avalue : cond | annotation | '{' (avalue %% ',')? '}' | '{' ',' '}'
class : 'class' ident tparams? ('extends' ctype)? ('implements' ctype % ',')? ('permits' ctype % ',')? body
body : '{' member* '}'
enum : 'enum' ident ('implements' ctype % ',')? '{' (constant % ',')? ','? (';' member*)? '}'
constant : annotation* ident args? body?
record : 'record' ident tparams? '(' (component % ',')? ')' ('implements' ctype % ',')? body
component : modifier* jtype annotation* '...'? ident
interface : 'interface' ident tparams? ('extends' ctype % ',')? ('permits' ctype % ',')? body
atype : '@' 'interface' ident body
tparams : '<' tparam % ',' '>'
tparam : annotation* ident ('extends' ctype % '&')?
member : ';' | modifier* field | modifier* method | modifier* typedecl | 'static'? block | modifier* ident block
field : jtype declarator % ',' ';'
declarator : ident dims? ('=' init)?
init : expr | '{' (init %% ',')? '}' | '{' ',' '}'
method : tparams? annotation* (jtype | 'void') ident '(' params? ')' dims? throws? ('default' avalue)? (block | ';') | tparams? ident '(' params? ')' throws? block
throws : 'throws' ctype % ','
params : param % ','
param : modifier* jtype annotation* '...'? ident dims? | modifier* jtype (ident '.')? 'this'
dims : (annotation* '[' ']')+
jtype : (prim | ctype) dims?
prim : annotation* ('int' | 'long' | 'short' | 'byte' | 'char' | 'float' | 'double' | 'boolean')
ctype : annotation* ident targs? | ctype '.' annotation* ident targs?
targs : '<' (targ % ',')? '>'
targ : jtype | annotation* '?' (('extends' | 'super') jtype)?
block : '{' stmt* '}'
local : modifier* jtype declarator % ','
stmt : block | ';' | local ';' | modifier* (class | enum | record | interface) | sexpr ';' | ident ':' stmt
  | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' finit? ';' expr? ';' (sexpr % ',')? ')' stmt | 'for' '(' modifier* jtype ident dims? ':' expr ')' stmt
  | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'throw' expr ';' | 'yield' expr ';' | 'synchronized' '(' expr ')' block
  | 'assert' expr (':' expr)? ';' | 'try' block (catch+ finally? | finally) | 'try' '(' resource %% ';' ')' block catch* finally? | 'switch' '(' expr ')' sbody
  | ('this' | 'super') args ';' | targs ('this' | 'super') args ';' | post '.' targs? 'super' args ';'
finit : local | sexpr % ','
sexpr : post assignop expr | ('++' | '--') unary | post ('++' | '--') | call | newx
catch : 'catch' '(' modifier* ctype % '|' ident ')' block
finally : 'finally' block
resource : modifier* jtype ident '=' expr | post
sbody : '{' sgroup* slabel* '}' | '{' srule* '}'
sgroup : slabel+ stmt+
slabel : 'case' clabels ':' | 'default' ':'
srule : ('case' clabels | 'default') '->' (expr ';' | block | 'throw' expr ';')
clabels : clabel % ',' | clabel % ',' 'when' expr
clabel : cond | 'default' | pattern
pattern : modifier* jtype ident | ctype '(' (pattern % ',')? ')' ident?
expr : cond | post assignop expr | lambda
lambda : ident '->' (expr | block) | '(' (lparams | ident % ',')? ')' '->' (expr | block)
lparams : param % ','
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '<<' '=' | '>' '>=' | '>' '>' '>='
cond : binary | binary '?' expr ':' (cond | lambda)
binary : unary | binary binop unary | binary 'instanceof' ('final'? jtype | pattern)
binop : '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
unary : ('+' | '-' | '!' | '~' | '++' | '--') unary | post | post ('++' | '--') | cast
cast : '(' prim dims? ')' unary | '(' ctype dims? ('&' ctype)* ')' (castable | lambda)
castable : post | post ('++' | '--') | cast | ('!' | '~') unary
post : prim1 | call | newx | arr
prim1 : literal | 'this' | '(' expr ')' | ident | post '.' ident | post '.' 'this' | 'super' '.' ident | post '.' 'super' '.' ident | (prim dims? | 'void') '.' 'class' | ident dims '.' 'class' | post '.' ident dims '.' 'class' | post '.' 'class'
  | mref | 'switch' '(' expr ')' sbody
arr : post '[' expr ']'
call : ident args | post '.' targs? ident args | 'super' '.' targs? ident args | post '.' 'super' '.' targs? ident args
mref : post '::' targs? (ident | 'new') | 'super' '::' targs? ident | (prim dims | ctype dims?) '::' targs? (ident | 'new')
newx : 'new' targs? annotation* ctype args body? | post '.' 'new' targs? ctype args body? | 'new' annotation* (prim | ctype) (dims '{' (init %% ',')? '}' | dims '{' ',' '}' | ('[' expr ']')+ dims?)
args : '(' (expr % ',')? ')'
literal : NUMBER | STRING | CHAR | 'true' | 'false' | 'null'
ident : NAME | 'record' | 'sealed' | 'permits' | 'when' | 'module' | 'open' | 'requires' | 'transitive' | 'exports' | 'opens' | 'to' | 'uses' | 'provides' | 'with' | 'non' | 'yield'
"""
#: Reserved words of Java that the grammar does not name.
JAVA_RESERVED = "const goto _".split()

GO = r"""
file : 'package' NAME ';' (import ';')* (top ';')*
import : 'import' spec | 'import' '(' (spec %% ';')? ')'
spec : ('.' | NAME)? STRING
top : decl | func
decl : 'const' cspec | 'const' '(' (cspec %% ';')? ')' | 'var' vspec | 'var' '(' (vspec %% ';')? ')' | 'type' tspec | 'type' '(' (tspec %% ';')? ')'
cspec : names (type? '=' exprs)?
vspec : names (type ('=' exprs)? | '=' exprs)
tspec : NAME tparams? '='? type
tparams : '[' (names constraint) %% ',' ']'
constraint : term % '|'
term : '~'? type
names : NAME % ','
func : 'func' NAME tparams? signature block? | 'func' params NAME signature block?
signature : params result?
result : type | params
params : '(' (param %% ',')? ')'
param : type | NAME type | NAME? '...' type
type : tname | '(' type ')' | littype
tname : NAME targs? | NAME '.' NAME targs?
targs : '[' type %% ',' ']'
littype : '*' type | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | 'func' signature | struct | iface
struct : 'struct' '{' (sfield %% ';')? '}'
sfield : names type STRING? | '*'? tname STRING?
iface : 'interface' '{' (ielem %% ';')? '}'
ielem : NAME signature | constraint
block : '{' stmts '}'
stmts : stmt % ';'
stmt : simple? | decl | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | switch | select | for | NAME ':' stmt | 'go' expr | 'defer' expr
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
if : 'if' (simpleH? ';')? exprH block ('else' (if | block))?
switch : 'switch' (simpleH? ';')? simpleH? '{' clause* '}'
clause : ('case' (expr | littype) % ',' | 'default') ':' stmts
select : 'select' '{' comm* '}'
comm : ('case' simple | 'default') ':' stmts
for : 'for' block | 'for' exprH block | 'for' simpleH? ';' exprH? ';' simpleH? block | 'for' (exprsH ('=' | ':='))? 'range' exprH block
@expressions@
binop : '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
index : (expr | littype) %% ',' | expr? ':' expr? | expr? ':' expr ':' expr
args : arg %% ',' | arg % ',' '...' ','?
arg : expr | littype
lbody : '{' (element %% ',')? '}'
element : (value ':')? value
value : expr | lbody
"""

#: Expressions, and (H) those between a keyword and the block it opens: there a composite literal of a named type needs parentheses.
_GO_EXPRESSIONS = r"""
simple@ : expr@ | expr@ '<-' expr@ | expr@ ('++' | '--') | exprs@ assignop exprs@ | exprs@ ':=' exprs@
exprs@ : expr@ % ','
expr@ : unary@ | expr@ binop unary@
unary@ : ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary@ | primary@
primary@ : operand@ | primary@ '.' NAME | primary@ '.' '(' (type | 'type') ')' | primary@ '[' index ']' | primary@ '(' args? ')'
operand@ : NAME | NUMBER | STRING | CHAR | '(' expr ')' | 'func' signature block | composite@ | littype '(' expr ','? ')' | '(' littype ')' '(' expr ','? ')'
"""
GO = GO.replace("@expressions@", _GO_EXPRESSIONS.replace("@", "").strip() + _GO_EXPRESSIONS.replace("@", "H") + "composite : (tname | littype) lbody\ncompositeH : littype lbody")

RUST = r"""
file : inner* item*
inner : '#' '!' '[' tokens ']'
outer : '#' '[' tokens ']'
tokens : tree*
tree : '(' tokens ')' | '[' tokens ']' | '{' tokens '}' | leaf
item : outer* vis? bare | outer* macroitem
vis : 'pub' ('(' ('crate' | 'self' | 'super' | 'in' spath) ')')? | 'crate'
bare : 'mod' ident ';' | 'mod' ident '{' inner* item* '}' | 'extern' 'crate' (ident | 'self') ('as' (ident | '_'))? ';' | 'use' usetree ';'
  | quals 'fn' fnrest | 'type' ident generics? (':' bounds?)? where? ('=' type)? where? ';' | struct | 'enum' ident generics? where? '{' (variant %% ',')? '}' | 'union' ident generics? where? fields
  | 'const' (ident | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? ident ':' type ('=' expr)? ';'
  | 'unsafe'? 'auto'? 'trait' ident generics? (':' bounds?)? where? '{' inner* item* '}'
  | 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' inner* item* '}' | 'unsafe'? 'extern' STRING? '{' inner* item* '}'
quals : 'const'? 'async'? 'unsafe'? ('extern' STRING?)?
macroitem : spath '!' ident? (delim ';' | '{' tokens '}')
delim : '(' tokens ')' | '[' tokens ']'
usetree : upath ('as' (ident | '_'))? | (upath? '::')? '*' | (upath? '::')? '{' (usetree %% ',')? '}'
upath : '::'? pseg % '::'
spath : '::'? pseg % '::'
pseg : ident | 'self' | 'super' | 'crate' | 'Self'
fnrest : ident generics? '(' fparams? ')' ('->' type)? where? (block | ';')
fparams : fparam %% ','
fparam : outer* (pattern1 ':' (type | '...') | selfp | '...')
selfp : ('&' LIFE?)? 'mut'? 'self' (':' type)?
struct : 'struct' ident generics? where? (fields | ';') | 'struct' ident generics? '(' (tfield %% ',')? ')' where? ';'
fields : '{' ((outer* vis? ident ':' type) %% ',')? '}'
tfield : outer* vis? type
variant : outer* vis? ident (fields | '(' (tfield %% ',')? ')')? ('=' expr)?
generics : '<' (gparam %% ',')? '>'
gparam : outer* (LIFE (':' (LIFE % '+')?)? | ident (':' bounds?)? ('=' type)? | 'const' ident ':' type ('=' (block | '-'? literal | ident))?)
where : 'where' (wpred %% ',')?
wpred : forlt? type ':' bounds? | LIFE ':' (LIFE % '+')?
forlt : 'for' generics
bounds : bound % '+' '+'?
bound : LIFE | ('?' | '~' 'const')? forlt? tpath | '(' '?'? forlt? tpath ')' | 'use' generics
type : tnoplus | tpath '+' bounds
tnoplus : tpath | '(' (type %% ',')? ')' | '!' | '*' ('mut' | 'const') tnoplus | '&' LIFE? 'mut'? tnoplus | '&&' LIFE? 'mut'? tnoplus | '[' type ']' | '[' type ';' expr ']' | '_'
  | forlt? quals 'fn' '(' (bareparam %% ',')? ')' ('->' tnoplus)? | 'impl' bounds | 'dyn' bounds | forlt tpath | qpath '::' tsegs | spath '!' (delim | '{' tokens '}')
bareparam : outer* ((ident | '_') ':')? type | '...'
tpath : '::'? tsegs
tsegs : tseg % '::'
tseg : pseg ('::'? gargs)? | pseg '::'? '(' (type %% ',')? ')' ('->' tnoplus)?
gargs : '<' (garg %% ',')? '>'
garg : LIFE | type | block | '-'? literal | ident gargs? ('=' type | ':' bounds)
qpath : '<' type ('as' tpath)? '>'
pattern : '|'? pattern1 % '|'
pattern1 : prange | ('ref' 'mut'? | 'mut') ident ('@' pattern1)? | ident '@' pattern1 | '_' | '..' | ('&' | '&&') 'mut'? pattern1 | '(' (pattern %% ',')? ')' | '[' (pattern %% ',')? ']'
  | epath '(' (pattern %% ',')? ')' | epath '{' (pfield %% ',')? '}' | 'box' pattern1 | spath '!' (delim | '{' tokens '}')
pfield : outer* ((ident | NUMBER) ':' pattern | ('ref'? 'mut'? ident) | '..')
prange : pval | pval ('..=' | '...' | '..') pval? | ('..=' | '..') pval
pval : '-'? literal | epath
block : '{' inner* stmt* expr? '}'
stmt : ';' | item | outer* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | outer* expr ';' | outer* blocky
blocky : label? (block | 'loop' block | 'while' cond block | 'for' pattern 'in' expr block) | 'unsafe' block | 'async' 'move'? block | 'const' block | if | 'match' expr '{' inner* arms? '}' | spath '!' '{' tokens '}'
if : 'if' cond block ('else' (if | block))?
cond : expr
arms : arm* lastarm
arm : outer* pattern ('if' cond)? '=>' (expr ',' | blocky ','?)
lastarm : outer* pattern ('if' cond)? '=>' expr ','?
label : LIFE ':'
expr : binary | binary assignop expr | range | jump | closure | binary binop (jump | closure)
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<' '<=' | '>' '>='
range : binary ('..' | '..=') binary? | ('..' | '..=') binary?
jump : 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'yield' expr?
closure : forlt? 'static'? 'async'? 'move'? ('||' | '|' (cparam %% ',')? '|') (expr | '->' tnoplus block)
cparam : outer* pattern1 (':' type)?
binary : unary | binary binop unary | binary 'as' tnoplus
binop : '||' | '&&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '<' '<' | '>' '>'
unary : ('-' | '!' | '*') unary | ('&' | '&&') 'mut'? unary | ('&' | '&&') 'raw' ('const' | 'mut') unary | ('&' | '&&' | '-' | '!' | '*') (jump | closure) | post | 'let' pattern '=' unary | 'box' unary
post : prim | post '?' | post '.' (ident | NUMBER | 'await') | post '.' ident '::' gargs '(' args ')' | post '.' ident '(' args ')' | post '(' args ')' | post '[' expr ']'
args : ((outer* expr) %% ',')?
prim : literal | epath | epath '{' (sfield %% ',')? ('..' expr?)? '}' | '(' (expr %% ',')? ')' | '[' (expr %% ',')? ']' | '[' expr ';' expr ']' | blocky | spath '!' delim
sfield : outer* (ident | (ident | NUMBER) ':' expr)
epath : '::'? eseg % '::' | qpath '::' eseg % '::'
eseg : pseg | gargs
literal : NUMBER | STRING | CHAR | 'true' | 'false'
ident : NAME | 'union' | 'auto' | 'raw' | 'default'
"""

_SCRIPT = r"""
program : item*
item : stmt | import | export
semi : ';' | ASI
import : 'import' STRING attrs? semi | 'import' iclause 'from' STRING attrs? semi «import»
iclause : ident | named | '*' 'as' ident | ident ',' (named | '*' 'as' ident)
named : '{' (spec %% ',')? '}'
spec : «type» xname ('as' xname)?
xname : name | STRING
attrs : (with | 'assert') '{' (((name | STRING) ':' STRING) %% ',')? '}'
export : 'export' «type» named ('from' STRING attrs?)? semi | 'export' «type» '*' ('as' xname)? 'from' STRING attrs? semi | 'export' decl | 'export' vars semi
  | 'export' 'default' (assignD semi | function | class) «export»
decl : function | class «decl»
@statements@
varkind : 'var' | 'let' | 'const' | 'using'
«vars»
forinit : vars | expr
binding : ident | pattern
pattern : '{' ((bprop) %% ',')? '}' | '{' (bprop % ',' ',')? '...' ident '}' | '[' belems? ']'
bprop : ident ('=' assign)? | propname ':' binding ('=' assign)?
belems : ','+ | ','* belem (','+ belem)* ','*
belem : binding ('=' assign)? | '...' binding
params : (param % ',')? | param % ',' ',' | (param % ',' ',')? rest
param : «pmods» binding «opt» «ann» ('=' assign)?
rest : «decos» '...' binding «ann»
function : 'async'? 'function' '*'? ident? «tparams» '(' params ')' «ret» blockF
class : «decos» 'class' ident? «tparams» ('extends' call «targs»)? «impl» '{' member* '}'
member : ';' | «mods» method | «mods» propname «optbang» «ann» ('=' assign)? semi | 'static' block «member»
method : ('async'? '*'? | 'get' | 'set') propname «opt» «tparams» '(' params ')' «ret» blockF
propname : name | STRING | NUMBER | '[' assign ']' | PRIVATE
expr : assign % ','
exprS : assignS | assignS ',' expr
assign : cond | call assignop assign | cover '=' assign | arrow | yield «assign»
assignS : condS | callS assignop assign | coverA '=' assign | arrow | yield «assign»
assignD : cond | call assignop assign | cover '=' assign | arrow | yield «assign»
cover : coverO | coverA
coverO : '{' cprops ','? '}'
coverA : '[' celems ','* ']'
cprops : cprop | props ',' cprop | cprops ',' prop | cprops ',' cprop
cprop : ident '=' assign | propname ':' cover
celems : ','* carg | elemlist ','+ carg | celems ','+ (arg | carg)
carg : '...'? cover
yield : 'yield' | 'yield' '*'? assign
arrow : 'async'? ident '=>' abody | 'async'? «tparams» '(' params ')' «ret» '=>' abody
abody : blockF | assignS | function | class
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '<' '<=' | '>' '>=' | '>' '>' '>=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
cond : binary | binary '?' assign ':' assign
condS : binaryS | binaryS '?' assign ':' assign
binary : unary | binary binop unary | PRIVATE 'in' unary «binary»
binaryS : unaryS | binaryS binop unary | PRIVATE 'in' unary «binaryS»
binop : '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '**'
unary : prefix unary | call | call ('++' | '--') «unary»
unaryS : prefix unary | callS | callS ('++' | '--') «unary»
prefix : 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | '++' | '--' | 'await'
call : primary | call suffix
callS : primaryS | callS suffix
suffix : '.' (name | PRIVATE) | '?.' (name | PRIVATE) | '?.' '[' expr ']' | '?.' «targs» args | '[' expr ']' | args | template «suffix»
args : '(' (arg %% ',')? ')'
arg : '...'? assign
primary : primaryS | object | function | class
primaryS : ident | NUMBER | STRING | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' elems? ']' | 'new' member1 | 'new' '.' name | 'import' args | 'import' '.' name
member1 : primary | member1 '.' (name | PRIVATE) | member1 '[' expr ']' | member1 template
elems : ','+ | elemlist ','*
elemlist : ','* arg | elemlist ','+ arg
object : '{' '}' | '{' props ','? '}'
props : prop | props ',' prop
prop : ident | propname ':' assign | method | '...' assign
template : TFULL | THEAD expr (TMID expr)* TTAIL
with : 'with' | WITH
ident : lexical | 'let'
lexical : NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'as' | 'from' | 'target' | 'assert' | 'using' «ident»
name : NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'as' | 'from' | 'target' | 'assert' | 'using' | 'let' | 'await' | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else'
  | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | with | 'yield' | 'enum' «ident»
"""

_WORDS = "'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'accessor' | 'keyof' | 'unique' | 'infer' | 'is' | 'asserts' | 'satisfies' | 'implements' | 'global' | 'require' | 'out'"

_TYPED = {
    "import": "| 'import' 'type' iclause 'from' STRING attrs? semi | 'import' 'type'? ident '=' (tname | 'require' '(' STRING ')') semi",
    "type": "'type'?",
    "export": "| 'export' '=' expr semi | 'export' 'as' 'namespace' ident semi | 'export' 'import' ident '=' (tname | 'require' '(' STRING ')') semi | 'export' 'default' 'abstract' class | 'export' 'default' interface",
    "decl": "| 'declare' decl | 'declare' vars semi | 'declare' 'global' '{' item* '}' | 'abstract' class | decorators 'abstract' class | 'type' ident tparams? '=' type semi | interface | 'const'? 'enum' ident '{' (enumerator %% ',')? '}'"
    " | ('namespace' | 'module') (ident % '.' | STRING) '{' item* '}' | 'declare' 'module' STRING semi | 'async'? 'function' '*'? ident? tparams? '(' params ')' ret? semi",
    "ann": "(':' type)?",
    "bang": "'!'?",
    "opt": "'?'?",
    "optbang": "('?' | '!')?",
    "pmods": "decorators? pmod*",
    "decos": "decorators?",
    "tparams": "tparams?",
    "ret": "ret?",
    "targs": "targs?",
    "impl": "('implements' (tname targs?) % ',')?",
    "mods": "decorators? mod*",
    "member": "| mod* index semi | decorators? mod* ('async'? '*'? | 'get' | 'set') propname '?'? tparams? '(' params ')' ret? semi",
    "assign": "",
    "binary": "| binary 'as' ('const' | type) | binary 'satisfies' type",
    "binaryS": "| binaryS 'as' ('const' | type) | binaryS 'satisfies' type",
    "unary": "| '<' ('const' | type) '>' unary",
    "suffix": "| '!' | targs args | targs template | targs",
    "ident": "| " + _WORDS,
}

_TYPES = r"""
pmod : 'public' | 'private' | 'protected' | 'readonly' | 'override'
mod : 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'accessor' | 'async'
decorators : ('@' call)+
tparams : '<' tparam %% ',' '>'
tparam : ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)?
targs : '<' type %% ',' '>'
ret : ':' rtype
rtype : type | (ident | 'this') 'is' type | 'asserts' (ident | 'this') ('is' type)?
interface : 'interface' ident tparams? ('extends' (tname targs?) % ',')? objtype
enumerator : propname ('=' assign)?
type : union | union 'extends' union '?' type ':' type | tparams? '(' params ')' '=>' rtype | 'abstract'? 'new' tparams? '(' params ')' '=>' type
union : '|'? inter % '|'
inter : '&'? tunary % '&'
tunary : ('keyof' | 'unique' | 'readonly') tunary | 'infer' ident ('extends' tunary)? | tpost
tpost : tprim | tpost '[' ']' | tpost '[' type ']'
tprim : tname targs? | STRING | NUMBER | '-' NUMBER | 'null' | 'void' | 'this' | 'true' | 'false' | '(' type ')' | objtype | '[' (telem %% ',')? ']' | 'typeof' tname targs? | 'typeof'? 'import' '(' type ')' ('.' tname)? targs? | ttemplate
telem : '...'? type | '...'? name '?'? ':' type | type '?'
ttemplate : TFULL | THEAD type (TMID type)* TTAIL
tname : ident | 'this' '.' name | tname '.' name
objtype : '{' (tmember (';' | ',' | ASI))* '}' | '{' (tmember (';' | ',' | ASI))* tmember '}' | '{' (('+' | '-')? 'readonly')? '[' ident 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? (';' | ',' | ASI)? '}'
tmember : 'readonly'? propname '?'? (':' type)? | ('get' | 'set')? propname '?'? sig | sig | 'new' sig | index
index : 'readonly'? '[' ident ':' type ']' ':' type
sig : tparams? '(' params ')' ret?
"""


#: Statements by what may stand in them: F inside of functions (return), B in a switch (break), L in a loop (break, continue).
#: WITH is the word where it may begin a statement, which it may not in strict code.
_STATEMENTS = r"""
stmt@ : block@ | vars semi | decl | ';' | exprS semi | 'if' '(' expr ')' stmt@ ('else' stmt@)?
  | 'for' 'await'? '(' forinit? ';' expr? ';' expr? ')' stmt@L | 'for' 'await'? '(' (varkind binding | call | cover) ('of' assign | 'in' expr) ')' stmt@L
  | 'while' '(' expr ')' stmt@L | 'do' stmt@L 'while' '(' expr ')' (';' | ASI)? | 'break' ident semi | WITH '(' expr ')' stmt@
  | 'switch' '(' expr ')' '{' case@B* '}' | ident ':' stmt@ | 'throw' expr semi | 'try' block@ (catch@ finally@? | finally@) | 'debugger' semi«jump»
block@ : '{' stmt@* '}'
case@ : ('case' expr | 'default') ':' stmt@*
catch@ : 'catch' ('(' binding «ann» ')')? block@
finally@ : 'finally' block@
"""


def _statements() -> str:
    out = ""
    for function in ("", "F"):
        for place in ("", "B", "L"):
            jumps = ("| 'return' expr? semi " if function else "") + ("| 'break' semi " if place else "") + ("| 'continue' ident? semi" if place == "L" else "")
            text = _STATEMENTS.replace("stmt@L", f"stmtL{function}").replace("case@B", f"case{place or 'B'}{function}").replace("«jump»", jumps)
            # A switch body stands in no statement position of its own where nothing may break.
            text = "\n".join(line for line in text.split("\n") if place or not line.startswith("case@"))
            out += text.replace("@", place + function)
    return out


def _script(slots: dict[str, str], more: str = "") -> str:
    import re

    text = _SCRIPT.replace("@statements@", _statements())
    return re.sub("«(\\w+)»", lambda m: slots.get(m[1], ""), text) + more


_STRICT_VARS = """vars : 'var' declarator % ',' | ('let' | 'using') lexicals % ',' | 'const' constant % ','
declarator : ident ('=' assign)? | pattern '=' assign
lexicals : lexical ('=' assign)? | pattern '=' assign
constant : (lexical | pattern) '=' assign"""
_TYPED_VARS = """vars : 'var' declarator % ',' | ('let' | 'const' | 'using') lexicals % ','
declarator : binding '!'? (':' type)? ('=' assign)?
lexicals : (lexical | pattern) '!'? (':' type)? ('=' assign)?"""
JAVASCRIPT = _script({"mods": "'static'?", "vars": _STRICT_VARS})
TYPESCRIPT = _script(_TYPED | {"vars": _TYPED_VARS}, _TYPES)
#: The this parameter of TypeScript and template types need no rule of their own above.
TYPESCRIPT = TYPESCRIPT.replace("param : decorators? pmod*", "param : 'this' (':' type)? | decorators? pmod*")

#: Words that are no identifiers, besides those that the grammars name.
RESERVED = {
    "javascript": [], "typescript": [],
    "go": [], "python": [], "java": JAVA_RESERVED,
    "rust": "abstract become do final macro override priv typeof unsized virtual try".split(),
}
