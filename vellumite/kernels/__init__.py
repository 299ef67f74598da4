"""Work inside one document: trees, selectors, styles and markup, called by the operators a batch of documents at a time."""
