"""Grammars of source languages over classes of tokens, and what follows from them: which classes may stand side by side.

A grammar is a text of productions ``name = ...``: 'xyz' is any one class of x, y, z; ``[a]`` is optional, ``{a}`` repeats,
``(a | b)`` chooses.  ``adjacent`` derives every pair of classes that some text of the grammar holds next to each other.
"""

from __future__ import annotations

import re
from functools import lru_cache

_PART = re.compile(r"'[^']*'|\w+|[|()\[\]{}]")

#: Parts that brace languages have in common: ``type`` and ``stmt`` are each language's own.
_EXPRESSION = """
expr = unary {binary unary}
unary = {prefix} primary {postfix}
args = [arg {',' arg} [',']]
"""

GRAMMARS = {
    "java": _EXPRESSION + """
unit = '^' {'k' qual ';' | 'I' ['M'] qual ['.' 'm'] ';' | member | ';'} '$'
qual = 'i' {'.' 'i'}
note = '@' 'iC' {'.' 'i'} ['(' args ')']
mods = {'M' | note}
targs = '<' [targ {',' targ}] '>'
targ = {note} ('?' ['X' type] | type {'Xm' type})
type = {note} 'i' [targs] {'.' {note} 'i' [targs]} {'[' ']'} ['e']
member = mods ([targs] type 'i' ({'[' ']'} ['=' value] {',' 'i' {'[' ']'} ['=' value]} ';' | rest) | [targs] 'i' rest | block | class) | mods 'i' block
rest = '(' [params] ')' {'[' ']'} ['X' type {',' type}] ['M' (expr | value)] (block | ';')
class = ('C' | 'M') 'i' [targs] ['(' [params] ')'] {('X' | 'M') type {',' type}} body
body = '{' [constant {',' constant} [','] [';']] {member | ';'} '}'
constant = {note} 'i' ['(' args ')'] [body]
params = mods type ['i' {'[' ']'}] {',' mods type ['i' {'[' ']'}]}
value = expr | '{' [value {',' value} [',']] '}'
arg = expr | note | value
block = '{' {stmt} '}'
local = mods type 'i' {'[' ']'} ['=' value] {',' 'i' {'[' ']'} ['=' value]}
stmt = block | ';' | expr ';' | local ';' | mods class | 'P' '(' [head] ')' stmt | 'QW' '(' expr ')' stmt | 'E' stmt | 'D' stmt | 'T' ['(' head ')'] block | 'K' '(' mods type {'m' type} 'i' ')' block | 'Y' block
stmt = 'R' [expr [':' expr]] ';' | 'i' ':' stmt | 'i' 'i' ';' | ('N' [pattern {',' pattern}] | 'M') (':' | 'a') | 'N' ['M'] expr ';'
pattern = expr | type 'i' ['M' expr] | 'M'
head = [part] {';:' [part]}
part = (local | expr) {',' (local | expr)}
binary = 'bm<>=?:' | '>' '>' ['>'] | 'X' ['M'] [type 'i' 'b']
prefix = '!mp' | '(' type {'m' type} ')'
primary = 'ins' | '(' expr ')' | 'i' 'a' lambda | '(' [params | 'i' {',' 'i'}] ')' 'a' lambda | 'N' type ('(' args ')' [body] | '[' [expr] ']' {'[' [expr] ']'} ['{' [value {',' value} [',']] '}']) | 'P' '(' expr ')' block | 'X' type 'i' | type 'd' ('i' | 'N') | type '.' 'C'
lambda = expr | block
postfix = '.' [targs] ('i' ['(' args ')'] | 'C' | 'N' type '(' args ')' | 'M') | '(' args ')' | '[' expr ']' | 'p' | 'd' ('i' | 'N')
""",
    "cs": _EXPRESSION + """
unit = '^' {'I' ['M'] ['V'] qual ['=' type] ';' | 'I' qual ('{' {member | 'I' qual ';'} '}' | ';') | member | stmt | 'i' 'i' ';'} '$'
qual = 'i' {('.' | 'd') 'i' [targs]}
note = '[' ['iMR' ':'] 'i' {'.' 'i'} ['(' args ')'] {',' 'i' {'.' 'i'} ['(' args ')']} ']'
mods = {'M' | note}
targs = '<' [mods type {',' [mods] type} | {','}] '>'
type = ('i' [targs] {('.' | 'd') 'i' [targs]} | '(' type ['i'] {',' type ['i']} ')' | 'M' type) {'?' | 'm' | '[' {','} ']'}
member = mods (type 'iM' [targs] {'.' 'i' [targs]} (fields ';' | rest | access) | [type] 'M' ['bm!<>p'] type ['i'] rest | 'i' rest | '!' 'i' rest | class | 'N' [type] 'i' [targs] rest | 'M' type 'i' ';')
fields = ['=' value] {',' 'i' ['=' value]}
access = '{' {mods ('M' | 'i') (';' | block | 'A' expr ';')} '}' ['=' value ';'] | 'A' expr ';'
rest = ['[' params ']'] ['(' [params] ')'] {where} [':' 'i' '(' args ')'] (block | ';' | 'A' expr ';' | access)
where = 'M' 'i' ':' (type | 'CNM' ['(' ')']) {',' (type | 'CNM' ['(' ')'])}
class = ('C' | 'M' ['C'] | 'N' type) 'i' [targs] ['(' [params] ')'] [':' type ['(' args ')'] {',' type}] {where} ('{' [constant {',' constant} [',']] {member | ';'} '}' | ';') [';']
constant = {note} 'i' ['=' expr]
params = mods type ['iM' ['=' expr]] {',' mods type ['iM' ['=' expr]]}
value = expr | '{' [value {',' value} [',']] '}'
arg = ['i' ':'] ['M'] (expr | type 'i' | value)
block = '{' {stmt} '}'
local = mods type 'iM' ['=' value] {',' 'i' ['=' value]} | 'i' '(' 'i' {',' 'i'} ')' '=' expr
stmt = block | ';' | expr ';' | ['N' | 'I'] local ';' | local rest | 'P' '(' [head] ')' stmt | 'QW' '(' expr ')' stmt | 'E' stmt | 'D' stmt | 'T' block | 'K' ['(' type ['i'] ')'] ['M' '(' expr ')'] block | 'Y' block | 'M' block | 'M' '(' expr ')' block
stmt = 'R' [expr] ';' | 'N' ['R' | 'N'] [pattern] [';'] | 'N' [pattern] ['M' expr] ':' | 'i' ':' stmt | 'I' ['V'] '(' (local | expr) ')' stmt | 'i' 'i' ';' | 'N' 'P' '(' head ')' stmt
head = [part] {';:' [part]}
part = (mods type 'i' 'X' expr | mods type ['i'] ['M' 'X'] expr | local | expr | mods type 'i' 'M' expr) {',' (local | expr)}
binary = 'bm<>=?:e' | '>' '>' | 'X' ['!' | 'i'] | 'A' | '?' '?' | 'X' pattern
pattern = ['i'] (expr | type ['i'] | '{' [arg {',' arg}] '}' ['i'] | '<>b' expr) [('i' | 'X') pattern]
prefix = '!mp' | '(' type ')' | 'M' | 'e' | 'N' | 'R'
primary = 'insM' | '(' arg {',' arg} ')' | ['M'] 'iM' 'A' lambda | ['M'] '(' [params | 'i' {',' 'i'}] ')' 'A' lambda | 'N' [type] ['(' args ')'] ['[' [args] ']'] ['{' [init {',' init} [',']] '}'] | 'N' ['(' [params] ')'] block | 'X' {expr 'X'} expr | 'P' '{' [arm {',' arm} [',']] '}' | '[' args ']'
init = value | '[' expr ']' '=' value
arm = pattern ['M' expr] 'A' expr
lambda = expr | block
postfix = ('.' | '?' '.' | 'a' | 'd') 'iMNCX' [targs] | '(' args ')' | '[' args ']' | 'p' | '!' | '?' '[' args ']' | 'P' '{' [arm {',' arm} [',']] '}' | 'M' '{' [init {',' init}] '}' | '{' [init {',' init} [',']] '}'
""",
    "php": _EXPRESSION + """
unit = '^' 'H' {stmt | 'H'} '$'
type = ['?'] ('i' | 'P' | 'M' | 'N' | '(' type {'m' type} ')') {'bm' type}
note = '#' '[' 'i' ['(' args ')'] {',' 'i' ['(' args ')']} ']'
mods = {'M' | note}
params = param {',' param} [',']
param = mods [type] ['m'] ['e'] 'v' ['=' expr]
member = mods ('F' ['m'] name '(' [params] ')' [':' type] (block | ';') | 'V' [type] name ['=' expr] {',' 'i' ['=' expr]} ';' | [type] 'v' ['=' expr] {',' 'v' ['=' expr]} (';' | block) | 'I' 'i' {',' 'i'} (';' | block) | 'N' 'i' ['=' expr] ';')
name = 'iPREINMVXFCkQWTDYKGq'
class = mods 'C' 'i' [':' type] {'X' 'i' {',' 'i'}} '{' {member} '}'
block = '{' {stmt | 'H'} '}'
stmt = block | ';' | 'H' | expr ('; H' | ';' | 'H') | class | 'F' ['m'] 'i' '(' [params] ')' [':' type] block | 'P' '(' [head] ')' (stmt | ':') | 'QWq' '(' expr ')' (stmt | ':' | 'H' | ';') | 'E' (stmt | ':' ) | 'D' stmt | 'T' block | 'K' '(' type {'m' type} ['v'] ')' block | 'Y' block
stmt = 'R' [expr {',' expr}] (';' | 'H') | 'I' ['F' | 'V'] 'i' ['X' 'i'] {',' ['F' | 'V'] 'i' ['X' 'i']} [block | '{' ['FV'] 'i' ['X' 'i'] {',' ['FV'] 'i' ['X' 'i']} [','] '}'] (';' | block) | 'V' 'i' '=' expr {',' 'i' '=' expr} ';' | 'N' [expr] ':;' | 'i' ':' | 'i' ';' | note | 'I' block | 'M' 'v' ['=' expr] {',' 'v' ['=' expr]} ';' | 'P' ';'
head = [part] {(';' | 'X') [part]}
part = ['m'] expr ['A' ['m'] expr] {',' expr}
binary = 'bm<>=?:eX' | '?' ':' | '=' 'm' | 'X' ['N'] | 'A'
prefix = '!mp' | '(' ('i' | 'P') ')' | 'e' | 'R' | 'N' | 'M'
primary = 'insv' | '(' expr ')' | 'P' ['(' args ')'] | '[' args ']' | ['M'] 'F' ['m'] '(' [params] ')' ['I' '(' ['m'] 'v' {',' ['m'] 'v'} [','] ')'] [':' type] (block | 'A' expr) | 'N' ('i' | 'v' | 'C' | 'M' | '(' expr ')') ['(' args ')'] | 'N' 'C' ['(' args ')'] {'X' 'i' {',' 'i'}} '{' {member} '}' | 'N' '(' expr ')' '{' [arm {',' arm} [',']] '}' | 'v' '{' expr '}' | 'C'
arm = expr {',' expr} [','] 'A' expr
arg = ['i' ':' | 'P' ':'] ['e'] ['m'] [expr ['A' ['m'] expr]] | ['e'] 'N' 'A' expr | 'e'
postfix = ('a' | 'd') (name | 'v' | '{' expr '}' | 'C') | '(' args ')' | '[' [expr] ']' | 'p' | '{' expr '}'
""",
    "ts": _EXPRESSION + """
unit = '^' {stmt} '$'
stmt = block | ';' | expr ';' | note stmt | {'M'} 'V' (bind {',' bind} | 'C' 'i' enums) ';' | {'M'} ['V'] class [';'] | {'M'} 'F' ['m'] ['i' | 'M'] sig (block | ';') | 'P' ['N'] '(' [head] ')' stmt | 'QW' '(' expr ')' stmt | 'E' stmt | 'D' stmt | 'T' block | 'K' ['(' bind ')'] block | 'Y' block
stmt = 'R' [expr] ';' | 'I' clause ';' | 'M' clause ';' | 'M' ['i' | 'M'] ';' | {'M'} 'M' 'i' [tparams] '=' type ';' | {'M'} 'M' ('i' | 's') {'.' 'i'} block | 'N' [expr] ':' | 'M' ':' | 'i' ':' stmt | 'M' (expr | '=' expr) ';'
clause = ['M'] ['iM' [',' group] | group] ['X' 's'] | 's' | 'iM' '=' 'i' '(' 's' ')' | '(' 's' ')' | 'M' 'iM' 'X' 's'
group = '{' [spec {',' spec} [',']] '}' | 'm' ['X' 'iM']
spec = ['M'] 'iMsX' ['X' 'iMX']
note = '@' ['.' 'i' {'.' 'i'} '(' args ')' | '(' args ')']
bind = target [':' type] ['!' ':' type] ['=' expr]
target = 'iMX' | '[' [['e'] bind | ','] {',' [['e'] bind]} ']' | '{' [prop {',' prop} [',']] '}'
prop = 'e' 'i' | ('iMNXRC' | 's' | 'n' | '[' expr ']') [':' target] ['=' expr]
head = ['V' bind {',' bind} | expr] {(';' | 'X') [expr]}
sig = [tparams] '(' [param {',' param} [',']] ')' [':' type]
param = {note} {'M'} ['e'] target ['?'] [':' type] ['=' expr]
tparams = '<' ['M'] 'i' ['X' type] ['=' type] {',' ['M'] 'i' ['X' type] ['=' type]} [','] '>'
type = {'N' | 'M'} single {'bm?:X' {'N' | 'M'} single}
single = ('iMXCFN' {'.' 'i'} ['<' type {',' type} '>'] ['X' type] | 'ns' | 'm' 'n' | '(' [param {',' param} [',']] ')' ['A' type] | '(' type ')' | '{' members '}' | '[' [['e'] type ['?'] {',' ['e'] type}] ']' | 'N' sig 'A' type | '<' 'i' '>' '(' ')' 'A' type | 'b' type | '{' ['mM'] '[' 'i' 'X' type ']' ['?'] ':' type [';'] '}' | 'N' 'I' '(' 's' ')' | 'I' '(' 's' ')') {'[' [type] ']'}
class = ('C' | 'M' 'C') ['iM'] [tparams] {'X' 'i' {'.' 'i'} ['<' type {',' type} '>'] ['(' args ')'] {',' 'i' {'.' 'i'} ['<' type {',' type} '>']}} '{' members '}' | 'C' 'i' enums | 'C' enums
enums = '{' ['is' ['=' expr] {',' 'is' ['=' expr]} [',']] '}'
members = {note | {'MNV'} ['m'] key ['?'] sig block | {'M'} block | field ';,' | ';'} [field]
field = {'MNV'} ['m'] key ['?!'] [sig | [':' type] ['=' expr]] | sig | {'MmN'} '[' 'i' (':' | 'X') type ']' ['?'] ':' type | 'N' sig
key = 'iMsnXNREPQWTKYDGCFIVk' | '[' expr ']' | '#'
block = '{' {stmt} '}'
binary = 'bm<>=?:X,' | '>' '>' ['>'] | 'X' 'M'
prefix = '!mpN' | 'M' | '<' type '>'
primary = 'insM' | 'X' | '(' [expr] ')' | '[' [['e'] expr | ','] {',' [['e'] expr]} ']' | object | ['M'] 'F' ['m'] ['i'] sig block | ['M'] sig 'A' lambda | ['M'] 'iMX' 'A' lambda | class | 'N' expr | 'I' '(' expr ')' | 'I' '.' 'i' | 'N' '.' 'i' | tparams sig 'A' lambda
object = '{' [entry {',' entry} [',']] '}'
entry = 'e' expr | {'M'} ['m'] key sig block | key ':' expr | 'iMX' ['=' expr]
lambda = expr | block
arg = ['e'] expr
postfix = '.' ('iMXNRCFIVPQWTKYDEk' | '#' | '[' expr ']' | '(' args ')') | '(' args ')' | '[' expr ']' | 'p' | '!' | '<' type {',' type} '>' ('(' args ')' | 's') | 's' | 'X' type
""",
    "go": _EXPRESSION + """
unit = '^' 'k' 'i' ';' {'I' ('(' {[ 'i.' ] 's' ';'} ')' | ['i.'] 's') ';'} {top ';'} '$'
top = 'F' ['(' [params] ')'] 'i' ['[' [params] ']'] sig [block] | 'V' spec
spec = '(' {one ';'} ')' | one
one = 'i' {',' 'i'} ['[' params ']'] ['='] [type] ['=' expr {',' expr}]
sig = '(' [params] ')' [type | '(' [params] ')']
params = param {',' param} [','] [';']
param = ['i' {',' 'i'}] ['e'] type
type = 'i' ['.' 'i'] ['[' type {',' type} ']'] | 'm' type | '[' [expr | 'e'] ']' type | 'X' '[' type ']' type | ['m'] 'X' ['m'] type | 'F' sig | 'C' '{' {field ';'} [field] '}' | '(' type ')' | '!' type | type 'b' type
field = ['i' {',' 'i'} | 'm'] [type] ['s'] | 'i' sig
block = '{' {stmt ';'} [stmt] '}'
stmt = [simple] | 'V' spec | 'Q' [simple ';'] simple block ['E' (stmt | block)] | 'W' [[simple] [';' [simple] ';' [simple]]] block | 'W' [expr {',' expr} '='] 'X' expr block | 'G' [simple] [';' [simple]] '{' {cases} '}' | block | 'i' ':' [stmt] | 'R' [expr {',' expr}]
cases = 'X' [simple | expr {',' expr} | type {',' type}] ':' {stmt ';'} [stmt]
simple = expr {',' expr} ['=m' ['X'] expr {',' expr}] ['p'] | expr 'p'
binary = 'bm<>'
prefix = '!m'
primary = 'ins' | '(' expr ')' | '(' type ')' | 'F' sig block | type literal | literal
literal = '{' [item {',' item} [',']] '}'
item = [expr ':'] expr
arg = (expr | type) ['e']
postfix = '.' ('i' | '(' ('V' | type) ')') | '(' args ')' | '[' [expr] [':' [expr]] [':' [expr]] ']' | literal | '[' type {',' type} ']'
""",
    "rust": _EXPRESSION + """
unit = '^' {item | 'i' '!' tree [';'] | 'I' path ';'} '$'
note = '#' ['!'] '[' meta {',' meta} ']'
meta = 'iMV' {'d' 'i'} ['(' [(meta | expr) {',' (meta | expr)} [',']] ')' | '=' expr]
vis = 'M' ['(' ['X'] path ')']
item = note | {vis} (fn | struct | 'V' ['M'] 'iF' [':' type] ['=' expr] ';' | 'V' 'i' [generics] [':' bounds] ['=' type] [wheres] ';' | 'I' tree2 ';' | 'I' 'i' ('{' {item} '}' | ';') | 'M' [generics] ['!'] type ['G' type] [wheres] '{' {item} '}' | {'M'} 's' '{' {item} '}' | 'i' '!' ['i'] tree [';'])
tree2 = ['d'] 'iI' {'d' ('iI' | 'm' | '{' [tree2 {',' tree2} [',']] '}')} ['X' 'i'] | 'm' | '{' [tree2 {',' tree2} [',']] '}'
tree = '(' args ')' | '[' args [';' expr] ']' | '{' {stmt} [expr] '}'
path = ['d'] 'iI' [tail] {'d' ('iI' | '<' targ {',' targ} '>') [tail]}
tail = '<' [targ {',' targ} [',']] '>'
targ = type | 'i' '=' type | 'jns' | '{' expr '}'
fn = {'M' ['s']} 'F' 'i' [generics] '(' [param {',' param} [',']] ')' ['a' type] [wheres] (block | ';')
param = {note} (['m' ['j']] ['M'] 'i' [':' type] | pattern ':' type)
generics = '<' [gen {',' gen} [',']] '>'
gen = ['V'] 'ij' [':' bounds] ['=' type]
bounds = [bound {'m' bound}]
bound = 'j' | ['?'] path ['(' [type {',' type}] ')' ['a' type]] | '(' bound ')' | 'G' generics bound
wheres = 'M' [(type | 'j') ':' bounds {',' (type | 'j') ':' bounds} [',']]
struct = 'CM' 'i' [generics] [':' bounds] [wheres] ('{' [member {',' member} [',']] '}' | '(' [{vis} type {',' {vis} type} [',']] ')' [wheres] ';' | ';' | '{' {item} '}')
member = {note} {vis} 'i' [':' type | '(' [type {',' type}] ')' | '{' [member {',' member} [',']] '}' | '=' expr]
type = path ['(' [type {',' type}] ')' ['a' type]] | 'mb' ['j'] ['M'] type | ['mM'] 'M' bounds | '(' [type {',' type} [',']] ')' | '[' type [';' expr] ']' | '!' | {'M' ['s']} 'F' '(' [type {',' type}] ')' ['a' type] | '<' type ['X' path] '>' 'd' 'i' | 'm' ['VM'] type | 'G' generics type
block = '{' {stmt} [expr] '}'
stmt = ';' | 'V' ['b'] pattern [':' type] ['=' expr ['E' block]] ';' | expr ';' | item | flow | note stmt | block
flow = ['j' ':'] ('Q' cond block ['E' (flow | block)] | 'W' cond block | 'G' pattern 'X' expr block | 'G' head '{' arms '}' | 'D' block | 'M' block)
cond = ['V' pattern '='] head {'b' 'V' pattern '=' expr}
head = {prefix} (simple {postfix} | flow) {binary unary}
arms = {arm (expr ',' | block [','])} [arm expr]
arm = {note} ['b'] pattern ['Q' head] 'A'
pattern = {'m' | 'M' | 'b'} ('i' ['@' pattern] | path ['(' [pattern {',' pattern} [',']] ')' | '{' [fieldp {',' fieldp} [',']] '}'] | 'ns' | 'm' 'n' | '(' [pattern {',' pattern} [',']] ')' | '[' [pattern {',' pattern}] ']' | 'e') {('b' | 'e') [pattern]}
fieldp = {'mM'} 'i' [':' pattern] | 'e'
binary = 'bm<>=e' | '>' '>' | 'X' type 'b' | 'm' | 'e'
prefix = '!m' | 'm' 'M' | 'b' | 'e' | 'N' | 'R' ['j'] | 'm' 'm'
primary = simple | block | flow | ['M'] closure | 'R' ['j'] [expr] | 'e' [expr]
simple = 'ns' | path ['!' tree] [fields] | '(' args ')' | '[' args [';' expr] ']' | '<' type ['X' path] '>' 'd' path
fields = '{' [fieldv {',' fieldv} [',']] ['e' expr] '}'
fieldv = 'in' [':' expr] | 'e' expr
closure = 'b' [pattern [':' type] {',' pattern [':' type]} 'b'] (expr | 'a' type block)
arg = expr | 'e' | type
postfix = '.' ('in' | 'N') ['d' tail] | '(' args ')' | '[' expr ']' | '?' | 'X' type | 'e'
""",
    "python": """
unit = '^' {line} '$'
line = {simple ';'} simple [';'] 'L' | compound | 'L'
suite = ':' ('L' | {simple ';'} simple [';'] 'L')
simple = 'R' [exprs] | 'R' exprs 'I' exprs | 'I' dotted ['X' 'i'] {',' dotted ['X' 'i']} | 'I' (dots [dotted] | dotted) 'I' ('m' | ['('] 'i' ['X' 'i'] {',' 'i' ['X' 'i']} [','] [')']) | exprs [':' expr] {'=' exprs} | 'R' 'i' | 'i' 'i' ['[' args ']'] '=' expr | 'e'
dots = {'.' | 'e'} ('.' | 'e')
dotted = 'i' {'.' 'i'}
compound = ['M'] ('G' exprs ['X' exprs] suite | 'F' 'i' ['[' args ']'] '(' [params] ')' ['a' expr] suite) | 'C' 'i' ['[' args ']'] ['(' args ')'] suite | 'QqW' expr suite | 'ETY' suite | 'K' ['m'] [expr {',' expr} ['X' 'i']] suite | '@' expr 'L'
params = param {',' param} [',']
param = ['m' | 'b'] 'i' [':' expr] ['=' expr] | 'm' | 'b'
exprs = ['m'] expr {',' ['m'] expr} [',']
expr = unary {binary unary} ['Q' expr 'E' expr]
unary = {prefix} primary {postfix}
binary = 'bm<>X' | 'X' 'N' | 'N' 'X' | 'X' 'XN' | '='
prefix = 'mN' | '!'
primary = 'in' | 's' {'s'} | '(' [inner] ')' | '[' [inner] ']' | '{' [inner] '}' | 'N' [params] ':' expr | 'N' ['I'] [exprs] | 'e' | 'G' | 'K'
inner = item {',' item} [','] | item {comp}
item = ['mb'] expr [':' expr] | ['m'] expr ':' ['m'] expr
comp = ['M'] 'G' exprs 'X' expr {'Q' expr}
args = [arg {',' arg} [',']] | arg {comp}
arg = ['mb'] expr | 'i' '=' expr | 'e'
postfix = '.' 'i' | '(' args ')' | '[' slices ']'
slices = [slice {',' slice} [',']]
slice = ['m'] expr | [expr] ':' [expr] [':' [expr]] | 'e'
""",
}


def _parse(text: str) -> dict[str, list]:
    """Productions as nested lists: ('class', chars), ('name', n), ('seq', [...]), ('alt', [...]), ('opt', x), ('many', x)."""
    rules: dict[str, list] = {}
    for line in filter(None, text.split("\n")):
        name, _, right = line.partition(" = ")
        parts = _PART.findall(right)
        at = 0

        def alternatives(close: str | None) -> tuple:
            nonlocal at
            options, now = [], []
            while at < len(parts) and parts[at] != close:
                p = parts[at]
                at += 1
                if p == "|":
                    options.append(("seq", now))
                    now = []
                elif p in "([{":
                    inner = alternatives({"(": ")", "[": "]", "{": "}"}[p])
                    at += 1
                    now.append(inner if p == "(" else ("opt" if p == "[" else "many", inner))
                elif p[0] == "'":
                    now.append(("class", frozenset(p[1:-1].replace(" ", ""))))
                else:
                    now.append(("name", p))
            return ("alt", [*options, ("seq", now)])

        rules.setdefault(name, []).append(alternatives(None))
    return {n: ("alt", xs) for n, xs in rules.items()}


@lru_cache(maxsize=None)
def adjacent(grammar: str) -> frozenset[tuple[str, str]]:
    """Pairs of classes that stand side by side in some text of the grammar: what may end a part with what may begin the next."""
    rules = _parse(GRAMMARS[grammar])
    facts = {n: (False, frozenset(), frozenset()) for n in rules}  # may be empty, first classes, last classes
    pairs: set[tuple[str, str]] = set()

    def facts_of(x: tuple) -> tuple[bool, frozenset, frozenset]:
        kind, body = x
        if kind == "class":
            return not body, body, body
        if kind == "name":
            return facts[body]
        if kind == "alt":
            all_ = [facts_of(y) for y in body]
            return any(f[0] for f in all_), frozenset().union(*[f[1] for f in all_]), frozenset().union(*[f[2] for f in all_])
        if kind in ("opt", "many"):
            _, first, last = facts_of(body)
            if kind == "many":
                pairs.update((a, b) for a in last for b in first)
            return True, first, last
        empty, first, last = True, frozenset(), frozenset()
        for y in body:
            e, f, l = facts_of(y)
            pairs.update((a, b) for a in last for b in f)
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
        return empty, first, last

    while True:
        size = len(pairs)
        new = {n: facts_of(x) for n, x in rules.items()}
        if new == facts and len(pairs) == size:
            return frozenset(pairs)
        facts = new


#: Statement productions over what is left of a block when brackets and inner blocks are taken out: s part of a statement, ; its
#: end, B a block, S a statement, U a try with resources, and the keywords Q if, q else-if, E else, W while, D do, T try, K catch, Y
#: finally.  The reductions are tried in this order until nothing changes.
REDUCTIONS = [
    (r"s*[;B]", "S"), (r"TS(?:(?:KS)+(?:YS)?|YS)", "S"), (r"US(?:KS)*(?:YS)?", "S"), (r"DSWS", "S"), (r"(?<!DS)WS", "S"), (r"(?:QS(?:E(?=Q)|(?=q)))+[Qq]", "Q"), (r"QSES", "S"), (r"QS(?![Eq])", "S"), (r"S+", "S"),
]
#: The same of Python's lines by their first words: Q if, q elif, E else, W while, G for or with, T try, K except, Y finally.
LINE_REDUCTIONS = [(r"Qq*E?", "s"), (r"[WG]E?", "s"), (r"T(?:K+E?Y?|Y)", "s"), (r"s+", "s")]
#: What may be left: statements only, or parts of them as well where an expression may stand without an end.
LEFT = {"strict": r"S?", "loose": r"[Ss]*", "lines": r"s?"}
