"""Reading source trees and knowledge-base documents."""
