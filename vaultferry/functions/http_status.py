"""Names of HTTP status codes as they appear in error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard status-code names without blanks.
STATUS_NAMES = {
    300: "MultipleChoices",
    301: "MovedPermanently",
    302: "Found",
    303: "SeeOther",
    304: "NotModified",
    307: "TemporaryRedirect",
    308: "PermanentRedirect",
    400: "BadRequest",
    401: "Unauthorized",
    402: "PaymentRequired",
    403: "Forbidden",
    404: "NotFound",
    405: "MethodNotAllowed",
    406: "NotAcceptable",
    407: "ProxyAuthenticationRequired",
    408: "RequestTimeout",
    409: "Conflict",
    410: "Gone",
    411: "LengthRequired",
    412: "PreconditionFailed",
    413: "RequestEntityTooLarge",
    414: "RequestUriTooLong",
    415: "UnsupportedMediaType",
    416: "RequestedRangeNotSatisfiable",
    417: "ExpectationFailed",
    421: "MisdirectedRequest",
    422: "UnprocessableEntity",
    423: "Locked",
    424: "FailedDependency",
    426: "UpgradeRequired",
    428: "PreconditionRequired",
    429: "TooManyRequests",
    431: "RequestHeaderFieldsTooLarge",
    451: "UnavailableForLegalReasons",
    500: "InternalServerError",
    501: "NotImplemented",
    502: "BadGateway",
    503: "ServiceUnavailable",
    504: "GatewayTimeout",
    505: "HttpVersionNotSupported",
    506: "VariantAlsoNegotiates",
    507: "InsufficientStorage",
    508: "LoopDetected",
    510: "NotExtended",
    511: "NetworkAuthenticationRequired",
}


def status_name(code: Column) -> Column:
    """Name of a status code; the number itself for codes without a name."""
    pairs = [c for k, v in STATUS_NAMES.items() for c in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code.cast("string"))
