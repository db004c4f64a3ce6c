"""Small literal inputs of the parsing queries."""

FILES = [
    ("src/auth.rs", """use crate::store::Session;
use std::fmt;

/// Saves a session.
pub fn save_session(s: &Session) -> bool {
    write_row(s)
}

pub fn login_user(name: &str) -> bool {
    let s = Session::Open(name);
    match s { Session::Open(_) => save_session(&s), _ => false }
}

pub struct Account { pub id: u64, pub current: Session, pub label: String }

impl Account {
    pub fn renew(&self) -> bool {
        save_session(&self.current)
    }
}
"""),
    ("src/store/mod.rs", """pub mod rows;
mod cache;

pub enum Session { Open(String), Closed, Expired { at: u64 } }

pub const LIMIT: usize = 10;

pub fn write_row(s: &Session) -> bool { rows::append(s) }
"""),
    ("src/store/rows.rs", """pub trait Sink<Session> { fn put(&self, s: Session); }

pub fn append(s: &Session) -> bool { flush_all(); true }
fn flush_all() { println!("flushed"); }
"""),
    ("src/empty.rs", ""),
    ("src/plain.rs", "// a comment\n// and another\nlet x = 1;\nlet y = 2;\n"),
]

DIFFS = [
    (1, "diff --git a/src/auth.rs b/src/auth.rs\n--- a/src/auth.rs\n+++ b/src/auth.rs\n@@ -1,4 +1,4 @@\n-pub fn login_user(name: &str) -> bool {\n+pub fn login_user(name: &str, again: bool) -> bool {\n+    audit(name);\n }\n"),
    (2, "diff --git a/src/auth.rs b/src/auth.rs\n--- a/src/auth.rs\n+++ b/src/auth.rs\n@@ -9 +9,3 @@\n+pub fn logout_user(name: &str) -> bool {\n+    false\n+}\n-fn flush_all() {\n"),
    (3, "diff --git a/a.md b/a.md\n--- a/a.md\n+++ b/a.md\n@@ -1 +1 @@\n+fn not_rust() {\n"),
    (4, "diff --git a/src/auth.rs b/src/auth.rs\n--- a/src/auth.rs\n+++ b/src/auth.rs\n@@ -14 +14,2 @@\n-pub struct Account {\n+pub struct Account {\n+    pub level: u8,\n"),
    (5, "diff --git a/src/store/mod.rs b/src/store/mod.rs\n--- a/src/store/mod.rs\n+++ b/src/store/mod.rs\n@@ -3 +3,2 @@\n+impl Sink for Session {\n+    fn put(&self) {\n"),
]
