import pytest

from bundlelens.js import parser
from bundlelens.js.printer import show

SCRIPTS = [
    '"use strict";import a,{b as c,default as d}from"./x.js";import*as ns from\'y\';export{a as default,c};export*from"./z";export const q=1,{r,s:[t=2,...u]}=v;export*as k from"j";import"side";export default x=>({a:1})',
    "export default async function*(){yield*x;for await(const y of z)await y}",
    '(self.webpackChunk=self.webpackChunk||[]).push([[1],{123:(e,t,n)=>{"use strict";n.d(t,{A:()=>r});var r=n(4)},"./a":function(e){e.exports=1}}]);',
    "class A extends(B,C){static #p=1;static{this.x=1}get y(){return this.#p}set y(v){}async*[Symbol.iterator](){}static async=2;constructor(){super()}}",
    "var f=async(x,{y=1,...z}={},[w]=[])=>({a:1,b,c(){},get d(){return 1},[e]:2,...g}),h=async k=>k??l?.m?.[n]?.(o),p=x=>y=>({});",
    "if(a)b();else if(c)d\nfor(var i=0,j;i<10;i++){if(i in o)continue;break}for(const k in o);for(k of o);do{x--}while(x>0);while(1)y++;for(;;)z()",
    "lab:for(;;){break lab}switch(a){case 1:case 2:b();break;default:c()}try{a()}catch{b()}finally{c()}try{a()}catch({e}){throw e}",
    "x=`a${b+`c${d}`}e`;y=a?b:c?d:e;z=/re[/]/g.test(s)/2;w=a**b**c;w=(a**b)**c;v=new Foo;u=new(foo().Bar)(1,...a);new.target;import.meta.url;void 0,typeof a;delete a.b;!function(){}();",
    "a||=b;a??=c;({a,b=2}=c);[a,,b]=c;let async=1;async();var{get,set,of}=q;(a??b)||c;-(-a);+(+b);(1).toFixed();a-(b-c);(a,b);(()=>{})();(function(){})();new(a())();new a.b.c;tag`x${1}y`",
    "a=b\n++c\nreturn_\n(d)\nvar e=1,\nf;if(g){}else;x={async:1,get:2,set(){},async*a(){},'k':1,2:3}",
]


@pytest.mark.parametrize("code", SCRIPTS)
def test_print_and_read_again(code):
    tree = parser.parse(code)
    text = show(tree)
    again = parser.parse(text)
    strip = lambda s: s.replace(", 'parenthesised=True", "")
    shape = lambda t: [(n.type, n.get("name"), n.get("operator"), n.get("value") if not isinstance(n.get("value"), parser.Node) else None) for n in parser.walk(t)]
    assert shape(again) == shape(tree), text
    assert strip(show(again)) == strip(text)


@pytest.mark.parametrize("code", ["(", "a b", "{", "x=>", "`${", "if(", "var 1", "1=2", "export {a b}", "class{", "[" * 500])
def test_refuses(code):
    assert parser.parse_or_none(code) is None


def test_positions():
    tree = parser.parse("a;\nfoo(b, 'c')")
    call = tree.body[1].expression
    assert (call.line, tree.body[1].start) == (2, 3) and "a;\nfoo(b, 'c')"[call.start : call.end] == "foo(b, 'c')"
