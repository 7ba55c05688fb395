"""The lines of code that texts turn into, and the outline nodes that each line has, by hand.

Per extension, sixteen lines that repeat: ``(line, nodes)``. ``¤`` stands for a
word of the text. A node is ``(type, text, ancestors)`` or, for a head that goes
on, ``(type, text, ancestors, lines that must follow)``; no text means the whole
line without the space around it. Every language closes what it opens, so that
ancestors are the same in each repetition.
"""

CODE = {
    ".js": [
        ("import { ¤ } from './lib/¤';", [("import_statement", None, "")]),
        ("class ¤ {", [("class_declaration", None, "")]),
        ("  ¤(a, b) {", [("method_definition", None, "class_declaration>class_body")]),
        ("    const ¤ = 1;", [("lexical_declaration", None, "class_declaration>class_body>method_definition>statement_block")]),
        ("  }", []),
        ("  async ¤(", [("method_definition", None, "class_declaration>class_body", 2)]),
        ("    a,", []),
        ("  ) {", []),
        ("    return a.replace(/\\/*$/, \"{\");", []),
        ("  }", []),
        ("}", []),
        ("export function ¤(x) {", [("export_statement", None, ""), ("function_declaration", "function ¤(x) {", "export_statement")]),
        (
            "  let ¤ = 2, b = 3;",
            [
                ("lexical_declaration", None, "export_statement>function_declaration>statement_block"),
                ("variable_declarator", "b = 3", "export_statement>function_declaration>statement_block>lexical_declaration"),
            ],
        ),
        ("}", []),
        ("const ¤ = (a) => {", [("lexical_declaration", None, "")]),
        ("};", []),
    ],
    ".jsx": [
        ("import ¤ from '¤';", [("import_statement", None, "")]),
        ("function ¤(p) {", [("function_declaration", None, "")]),
        ("  return <div className=\"¤\">x</div>;", []),
        ("}", []),
        ("export default class ¤ {", [("export_statement", None, ""), ("class_declaration", "class ¤ {", "export_statement")]),
        ("  render() {", [("method_definition", None, "export_statement>class_declaration>class_body")]),
        ("    var ¤ = p / 2 / 1;", [("variable_declaration", None, "export_statement>class_declaration>class_body>method_definition>statement_block")]),
        ("  }", []),
        ("}", []),
        ("export const ¤ = {", [("export_statement", None, ""), ("lexical_declaration", "const ¤ = {", "export_statement")]),
        ("  ¤(a) {", [("method_definition", None, "export_statement>lexical_declaration>variable_declarator>object")]),
        ("  },", []),
        ("};", []),
        ("function* ¤() {", [("generator_function_declaration", None, "")]),
        ("}", []),
        ("foo(`¤ ${ `{` }`);", []),
    ],
    ".ts": [
        ("export class ¤ {", [("export_statement", None, ""), ("class_declaration", "class ¤ {", "export_statement")]),
        ("  constructor(private a: string,", [("method_definition", None, "export_statement>class_declaration>class_body", 1)]),
        ("    b: number) {", []),
        ("  }", []),
        ("  private async ¤(a: string): Promise<void> {", [("method_definition", None, "export_statement>class_declaration>class_body")]),
        ("    if (a) { }", []),
        ("  }", []),
        ("  abstract ¤(a: string): void;", [("abstract_method_signature", None, "export_statement>class_declaration>class_body")]),
        ("}", []),
        ("interface ¤ {", [("interface_declaration", None, "")]),
        ("  ¤(a: number): string;", [("method_signature", None, "interface_declaration>interface_body")]),
        ("}", []),
        ("export const ¤ = 2;", [("export_statement", None, ""), ("lexical_declaration", "const ¤ = 2;", "export_statement")]),
        ("const open = '{'; class ¤ { }", [("lexical_declaration", "const open = '{';", ""), ("class_declaration", "class ¤ { }", "")]),
        ("function ¤(a: string): void;", [("function_signature", None, "")]),
        ("type ¤ = string;", [("type_alias_declaration", None, "")]),
    ],
    ".tsx": [
        ("import '¤/¤.tsx';", [("import_statement", None, "")]),
        (
            "export function ¤(): JSX.Element {",
            [("export_statement", None, ""), ("function_declaration", "function ¤(): JSX.Element {", "export_statement")],
        ),
        ("  let ¤ = 3;", [("lexical_declaration", None, "export_statement>function_declaration>statement_block")]),
        ("}", []),
        ("enum ¤ {", [("enum_declaration", None, "")]),
        ("}", []),
        ("export { ¤, b };", [("export_statement", None, "")]),
        ("namespace ¤ {", [("internal_module", None, "")]),
        (
            "  export function ¤<T>(",
            [
                ("export_statement", None, "internal_module>statement_block"),
                ("function_declaration", "function ¤<T>(", "internal_module>statement_block>export_statement"),
            ],
        ),
        ("    a: T,", []),
        ("  ): T {", []),
        ("  }", []),
        ("}", []),
        ("@Injectable({ a: 1 })", []),
        (
            "export abstract class ¤ {",
            [("export_statement", None, ""), ("abstract_class_declaration", "abstract class ¤ {", "export_statement")],
        ),
        ("}", []),
    ],
    ".py": [
        ("import ¤", [("import_statement", None, "")]),
        ("from os import ¤", [("import_from_statement", None, "")]),
        ("class ¤:", [("class_definition", None, "")]),
        ("    def ¤(self,", [("function_definition", None, "class_definition>block")]),
        ("          a=\")\"):", []),
        ("        return 1", []),
        ("    @staticmethod", []),
        ("    async def ¤(a):", [("function_definition", None, "class_definition>block")]),
        ("        if a:", []),
        ("            def ¤(): pass", [("function_definition", None, "class_definition>block>function_definition>block>statement>block")]),
        ("", []),
        ("def ¤(a):", [("function_definition", None, "")]),
        ("    \"\"\"class of", []),
        ("    def no(): \"\"\"", []),
        ("    pass", []),
        ("x = r'\\''", []),
    ],
    ".java": [
        ("package ¤;", [("package_declaration", None, "")]),
        ("import java.util.¤;", [("import_declaration", None, "")]),
        ("@Entity(name = \"{\") public class ¤ {", [("class_declaration", None, "")]),
        (
            "  private int ¤ = 5, b = 6;",
            [
                ("field_declaration", None, "class_declaration>class_body"),
                ("variable_declarator", "b = 6", "class_declaration>class_body>field_declaration"),
            ],
        ),
        ("  public ¤(int a) {", [("constructor_declaration", None, "class_declaration>class_body")]),
        ("  }", []),
        ("  @Override", []),
        ("  public int ¤(int n) { return n; }", [("method_declaration", None, "class_declaration>class_body")]),
        ("  <T> void ¤(T a,", [("method_declaration", None, "class_declaration>class_body", 1)]),
        ("      int b) throws E", []),
        ("  {", []),
        ("    String ¤ = \"}\";", [("local_variable_declaration", None, "class_declaration>class_body>method_declaration>block")]),
        ("  }", []),
        ("}", []),
        (
            "interface ¤ { void run(int a); }",
            [("interface_declaration", None, ""), ("method_declaration", "void run(int a);", "interface_declaration>interface_body")],
        ),
        ("enum ¤ { A }", [("enum_declaration", None, "")]),
    ],
    ".go": [
        ("package ¤", [("package_clause", None, "")]),
        ("import \"¤\"", [("import_declaration", None, "")]),
        ("func ¤(a int) int {", [("function_declaration", None, "")]),
        ("\t¤ := 1", [("short_var_declaration", None, "function_declaration>block")]),
        ("\tif y := a; y > 0 {", []),
        ("\t}", []),
        ("}", []),
        ("type ¤ struct {", [("type_declaration", None, "")]),
        ("\ta int", []),
        ("}", []),
        ("type ¤ interface {", [("type_declaration", None, "")]),
        ("\t¤(a int) error", [("method_spec", None, "type_declaration>type_spec>interface_type")]),
        ("}", []),
        ("func (s *T) ¤(", [("method_declaration", None, "")]),
        ("\ta int) {", []),
        ("}", []),
    ],
    ".rs": [
        ("use a::¤;", [("use_declaration", None, "")]),
        ("#[derive(Debug)]", []),
        ("pub struct ¤ {", [("struct_item", None, "")]),
        ("    a: u8,", []),
        ("}", []),
        ("impl X for Y {", [("impl_item", None, "")]),
        ("    pub fn ¤<T>(", [("function_item", None, "impl_item>declaration_list")]),
        ("        &self,", []),
        ("    ) -> u8 {", []),
        ("        let ¤ = r#\"}\"#;", [("let_declaration", None, "impl_item>declaration_list>function_item>block")]),
        ("    }", []),
        ("}", []),
        (
            "pub(crate) extern \"C\" fn ¤() { let q = '{'; }",
            [("function_item", None, ""), ("let_declaration", "let q = '{';", "function_item>block")],
        ),
        ("mod ¤ { const ¤: u8 = 1; }", [("mod_item", None, ""), ("const_item", "const ¤: u8 = 1;", "mod_item>declaration_list")]),
        ("trait ¤ { fn run(&self); }", [("trait_item", None, ""), ("function_signature_item", "fn run(&self);", "trait_item>declaration_list")]),
        ("enum ¤ { A }", [("enum_item", None, "")]),
    ],
    ".cpp": [
        ("#include <¤>", [("preproc_include", None, "")]),
        ("namespace ¤ {", [("namespace_definition", None, "")]),
        ("template<class T> class ¤ {", [("class_specifier", None, "namespace_definition>declaration_list")]),
        ("public:", []),
        ("  ¤(int a) : b(a) { }", [("function_definition", None, "namespace_definition>declaration_list>class_specifier>field_declaration_list")]),
        ("  virtual int ¤(int a) const = 0;", [("function_declarator", None, "namespace_definition>declaration_list>class_specifier>field_declaration_list")]),
        ("  int ¤ = 3;", [("field_declaration", None, "namespace_definition>declaration_list>class_specifier>field_declaration_list")]),
        ("};", []),
        ("}", []),
        ("using std::¤;", [("using_declaration", None, "")]),
        ("int ¤ = 0, b;", [("declaration", None, "")]),
        ("static int X::¤(int a,", [("function_definition", None, "", 1)]),
        ("    int b)", []),
        ("{", []),
        ("  const char* ¤ = R\"(class Q {)\";", [("declaration", None, "function_definition>compound_statement")]),
        ("}", []),
    ],
    ".c": [
        ("#include \"¤.h\"", [("preproc_include", None, "")]),
        ("typedef struct ¤ {", [("struct_specifier", None, "")]),
        ("  int a;", []),
        ("} ¤;", []),
        ("int ¤ = 1;", [("declaration", None, "")]),
        ("static int ¤(int a, int b) {", [("function_definition", None, "")]),
        ("  while (a) { b(a); }", []),
        ("  int ¤ = 0;", [("declaration", None, "function_definition>compound_statement")]),
        ("  return ¤(b);", []),
        ("}", []),
        ("unsigned long ¤(", [("function_definition", None, "", 1)]),
        ("    char a)", []),
        ("{", []),
        ("}", []),
        ("int ¤(int);", [("function_declarator", None, "")]),
        ("enum ¤ { A };", [("enum_specifier", None, "")]),
    ],
    ".cs": [
        ("using System.¤;", [("using_directive", None, "")]),
        ("namespace ¤", [("namespace_declaration", None, "")]),
        ("{", []),
        ("  [Attr(1)] public class ¤", [("class_declaration", None, "namespace_declaration>declaration_list")]),
        ("  {", []),
        ("    public string ¤ { get; set; }", [("property_declaration", None, "namespace_declaration>declaration_list>class_declaration>declaration_list")]),
        ("    private int ¤ = 3;", [("field_declaration", None, "namespace_declaration>declaration_list>class_declaration>declaration_list")]),
        ("    public ¤(int a) : base(a) { }", [("constructor_declaration", None, "namespace_declaration>declaration_list>class_declaration>declaration_list")]),
        ("    public int ¤(int n) => n;", [("method_declaration", None, "namespace_declaration>declaration_list>class_declaration>declaration_list")]),
        ("    void ¤(", [("method_declaration", None, "namespace_declaration>declaration_list>class_declaration>declaration_list", 1)]),
        ("      int a) {", []),
        (
            "      var ¤ = @\"}\\\";",
            [("local_declaration_statement", None, "namespace_declaration>declaration_list>class_declaration>declaration_list>method_declaration>block")],
        ),
        ("    }", []),
        ("  }", []),
        ("}", []),
        ("public record ¤(int X);", [("record_declaration", None, "")]),
    ],
    ".dart": [
        ("import '¤/¤.dart';", [("import_or_export", None, "")]),
        ("class ¤ extends B {", [("class_definition", None, "")]),
        ("  int ¤ = 3;", [("declaration", None, "class_definition>class_body")]),
        ("  X¤(this.a);", [("constructor_signature", None, "class_definition>class_body")]),
        ("  @override", []),
        ("  int ¤(int n) {", [("function_signature", None, "class_definition>class_body")]),
        ("    var ¤ = n;", [("local_variable_declaration", None, "class_definition>class_body>function_signature>block")]),
        ("    return n;", []),
        ("  }", []),
        ("}", []),
        ("int ¤(int n) => n;", [("function_signature", None, "")]),
        ("final ¤ = 1;", [("declaration", None, "")]),
        ("enum ¤ { a }", [("enum_declaration", None, "")]),
        ("Future<void> ¤(", [("function_signature", None, "", 1)]),
        ("  int a) async {", []),
        ("}", []),
    ],
    ".swift": [
        ("import ¤", [("import_declaration", None, "")]),
        ("struct ¤ {", [("class_declaration", None, "")]),
        ("  let ¤ = 1", [("property_declaration", None, "class_declaration>class_body")]),
        ("  @objc func ¤(_ v: Int) -> Int {", [("function_declaration", None, "class_declaration>class_body")]),
        ("    var ¤ = \"{\"", [("property_declaration", None, "class_declaration>class_body>function_declaration>block")]),
        ("  }", []),
        ("  init(", [("init_declaration", None, "class_declaration>class_body")]),
        ("    a: Int", []),
        ("  ) {", []),
        ("  }", []),
        ("}", []),
        ("protocol ¤ {", [("protocol_declaration", None, "")]),
        ("  func ¤(a: Int)", [("function_declaration", None, "protocol_declaration>class_body")]),
        ("}", []),
        ("extension ¤: B { }", [("class_declaration", None, "")]),
        ("public enum ¤ { case a }", [("class_declaration", None, "")]),
    ],
    ".kt": [
        ("package ¤", [("package_header", None, "")]),
        ("import a.¤", [("import_header", None, "")]),
        ("data class ¤(", [("class_declaration", None, "")]),
        ("  a: Int", []),
        (") : B() {", []),
        ("  override fun ¤(", [("function_declaration", None, "class_declaration>class_body")]),
        ("    a: Int", []),
        ("  ): Int {", []),
        ("    val ¤ = \"}\"", [("property_declaration", None, "class_declaration>class_body>function_declaration>block")]),
        ("  }", []),
        (
            "  companion object { val k = 1 }",
            [
                ("companion_object", None, "class_declaration>class_body"),
                ("property_declaration", "val k = 1", "class_declaration>class_body>companion_object>class_body"),
            ],
        ),
        ("}", []),
        ("@JvmStatic fun ¤() = 1", [("function_declaration", None, "")]),
        ("object ¤ { }", [("object_declaration", None, "")]),
        (
            "interface ¤ { fun run(a: Int) }",
            [("class_declaration", None, ""), ("function_declaration", "fun run(a: Int)", "class_declaration>class_body")],
        ),
        ("typealias ¤ = Int", [("type_alias", None, "")]),
    ],
    ".md": [(line, []) for line in ("# ¤", "class ¤ {", "text ¤", "", "- ¤", "}", "function ¤() {", ".") * 2],
}
CYCLE = 16
LINES = {ext: [line for line, _ in lines] for ext, lines in CODE.items()}


def nodes() -> list[tuple[str, int, int, int, str, str, str]]:
    """(extension, line, order, lines that must follow, type, text, ancestors) of every node."""
    out = []
    for ext, lines in CODE.items():
        for i, (line, found) in enumerate(lines):
            for k, (node_type, text, ancestors, *follow) in enumerate(found):
                out.append((ext, i, k, *(follow or [0]), node_type, text or line.strip(), ancestors))
    return out
