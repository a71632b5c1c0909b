"""The style keys that elements are compared by."""

# The keys in the order of the style arrays.
STYLE_KEYS = (
    "-moz-box-align", "-moz-box-flex", "-moz-box-ordinal-group", "-webkit-text-fill-color", "-webkit-text-stroke-color", "align-content", "align-items",
    "animation-delay", "animation-duration", "animation-fill-mode", "animation-name", "backface-visibility", "background-color", "background-image",
    "background-position", "background-position-x", "background-position-y", "background-repeat", "background-size", "border-bottom-color", "border-bottom-left-radius",
    "border-bottom-right-radius", "border-bottom-style", "border-bottom-width", "border-collapse", "border-left-color", "border-left-style", "border-left-width",
    "border-right-color", "border-right-style", "border-right-width", "border-spacing", "border-top-color", "border-top-left-radius", "border-top-right-radius",
    "border-top-style", "border-top-width", "bottom", "box-shadow", "box-sizing", "caret-color", "clear", "clip", "color", "column-rule-color", "cursor", "display",
    "filter", "flex-basis", "flex-grow", "flex-shrink", "float", "font-family", "font-feature-settings", "font-size", "font-size-adjust", "font-style", "font-variant",
    "font-variant-ligatures", "font-weight", "height", "hyphens", "justify-content", "left", "letter-spacing", "line-height", "list-style-image", "list-style-position",
    "list-style-type", "margin-bottom", "margin-left", "margin-right", "margin-top", "max-width", "min-height", "min-width", "opacity", "order", "outline-color",
    "outline-offset", "overflow", "overflow-wrap", "overflow-x", "overflow-y", "padding-bottom", "padding-left", "padding-right", "padding-top", "pointer-events",
    "position", "quotes", "right", "stroke", "stroke-miterlimit", "text-align", "text-decoration", "text-decoration-color", "text-decoration-line",
    "text-emphasis-color", "text-indent", "text-overflow", "text-rendering", "text-shadow", "text-transform", "top", "touch-action", "transform", "transition-delay",
    "transition-duration", "transition-property", "transition-timing-function", "vertical-align", "visibility", "white-space", "width", "word-break", "word-spacing",
    "z-index", "border-block-start-color", "border-block-end-color", "border-start-start-radius", "border-block-start-width", "padding-inline-end",
    "border-end-start-radius", "border-inline-end-width", "padding-block-end", "border-block-end-width", "border-inline-start-width", "border-inline-end-color",
    "border-end-end-radius", "border-inline-start-color", "padding-inline-start", "padding-block-start", "border-start-end-radius",
)
